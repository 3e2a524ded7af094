"""Check SQL of the Merkle manifest, built level by level."""

from __future__ import annotations

#: Levels that the SQL climbs: 8 ** 8 leaves of a tree and 64 trees.
LEVELS, TREE_LEVELS = 8, 2

FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
#: crc32 bit by bit over the decimal digits of a number.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
  lambda d: ascii(d)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
  lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _leaf(text: str) -> str:
    fields = [FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"({f})" for f in fields) + ")"


def _climb(name: str, levels: int) -> list[str]:
    """Tables name1.. of parents (a lone node stays) and name0_s.. with siblings."""
    steps = []
    for k in range(levels):
        run = "PARTITION BY t, p // 8 ORDER BY p ROWS BETWEEN"
        steps.append(f"""{name}{k}_s AS (SELECT t, p, n,
  coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})""")
        steps.append(f"""{name}{k + 1} AS (SELECT t, p // 8 AS p, (n + 7) // 8 AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h
  FROM {name}{k} GROUP BY t, p // 8, n)""")
    return steps


def _fold(before: str, name: str, levels: int, tree: str, place: str) -> list[str]:
    """Tables that follow every row up, growing its proof and folding its leaf."""
    steps = []
    for k in range(levels):
        steps.append(f"""{name}{k}_f AS (SELECT f.* EXCLUDE (proof, folded),
  proof || CASE WHEN s.n > 1 THEN b || a ELSE '' END AS proof,
  CASE WHEN s.n > 1 THEN sha256(b || folded || a) ELSE folded END AS folded
  FROM {before} f JOIN {name}{k}_s s ON s.t = {tree} AND s.p = {place} // {8**k})""")
        before = f"{name}{k}_f"
    return steps


def manifest_sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    last = f"top{TREE_LEVELS - 1}_f"
    steps = [
        f"hashed AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf(lower)} AS lowered, {CRC} AS crc FROM documents)",
        """placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY lang) AS total FROM hashed)""",
        "sub0 AS (SELECT t, place AS p, total AS n, leaf AS h FROM placed)",
        *_climb("sub", LEVELS),
        f"top0 AS (SELECT 0 AS t, t AS p, count(*) OVER () AS n, h FROM sub{LEVELS})",
        *_climb("top", TREE_LEVELS),
        """start AS (SELECT doc_id, leaf, t, place, '' AS proof,
  CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS folded FROM placed)""",
        *_fold("start", "sub", LEVELS, "f.t", "f.place"),
        *_fold(f"sub{LEVELS - 1}_f", "top", TREE_LEVELS, "0", "f.t"),
    ]
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = r.h AS verified
FROM {last} f JOIN sub{LEVELS} s ON s.t = f.t JOIN top{TREE_LEVELS} r ON true"""
    )
