"""Personal data: fixed forms, and identifiers found by bootstrapped contexts.

Fixed forms (e-mail, ip, card, phone) are matched by patterns with checks.  Besides
them every token with a digit, and every token behind a label, is a candidate.  Lexical
patterns are what an occurrence stands in: the label before it (letters and a
separator), one or two words on its left, on its right, one on either side, and the
letters that it begins with.  They stand for values of one kind, labels and prefixes
also for one kind and length.

Seed entities start the process: fixed forms by their own spans, key-like tokens (32 or
more hexadecimal digits, letters among them), and what follows a seed label.  They give
score 1 to their values; Spark then scores the graph of patterns and values in turns: a
pattern is worth the mean score of its values, a value the best of its patterns.
Patterns of high score and enough values extract the identifiers that no fixed form
knows, key-like tokens among them; seed labels always do, for values with a digit.

Everything is DataFrame expressions; what is shuffled are candidates, never texts.
Positions are running sums over slices of about the square root of a text's matches, so
a text with very many matches costs little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import look_up, stored
from parley.session import spread

#: Fixed forms in the order of the report.  The loops are possessive and begin where a
#: leftmost match must begin, which finds the same matches in linear time.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "identifier")
#: Characters of tokens: no white space, quotes, brackets or other delimiters.
_TOKEN = r"[^\s\p{Cntrl}\"'`<>()\[\]{},;:=#|&$%*!?]"
#: Tokens of four or more characters, without the punctuation at their end, that have a
#: digit, or stand behind a label and are none themselves.
CANDIDATE = (
    rf"(?<!{_TOKEN})(?:(?=[^\s\p{{Cntrl}}0-9\"'`<>()\[\]{{}},;:=#|&$%*!?]*+[0-9])"
    rf"|(?<=[A-Za-z_][\x20\t]{{0,2}}[=:#][\x20\t]{{0,2}}[\"']?)(?!{_TOKEN}*+[\x20\t]*+[=:#]))"
    rf"{_TOKEN}{{4,}}(?<=[\p{{L}}\p{{N}}_])"
)
#: Characters on each side of an occurrence in which its context is sought.
CONTEXT = 48
#: Key-like tokens, seed entities wherever they stand.
KEY = r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}$"
#: Labels whose values are known entities from the start.
SEED_LABELS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
ROUNDS = 3
#: Score and distinct values that a pattern needs to extract.
CONFIDENT, LEAST_VALUES = 0.8, 3


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_OCCURRENCE = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(amounts: Column, combine) -> Column:
    """For each of an array's amounts the combination of those before it, from 0.

    ``combine`` is associative.  The array is cut into slices of about the square root of
    its size, so that no growing array is copied for each of its elements.
    """

    def before(values: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))

        def step(state: Column, value: Column) -> Column:
            return F.struct(
                combine(state["at"], value).alias("at"),
                F.concat(state["out"], F.array(state["at"])).alias("out"),
            )

        return F.aggregate(values, start, step)["out"]

    def cut(values: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
        begins = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), size)
        return F.transform(begins, lambda begin: F.slice(values, begin, size))

    def joined(slices: Column) -> Column:
        totals = F.transform(slices, lambda part: F.aggregate(part, F.lit(0), combine))
        return F.flatten(F.zip_with(slices, before(totals, F.lit(0)), before))

    return _let(amounts, lambda values: _let(cut(values), joined))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def occurrences(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """Spans of the valid matches in code points, with the text on their left and right."""

    def end_of(part: Column) -> Column:
        return F.right(part, F.lit(CONTEXT))

    def begin_of(part: Column) -> Column:
        return F.left(part, F.lit(CONTEXT))

    def placed(hits: Column, gaps: Column) -> Column:
        lengths = F.zip_with(hits, gaps, lambda hit, gap: F.length(gap) + F.coalesce(F.length(hit), F.lit(0)))

        def one(hit: Column, i: Column, sums: Column) -> Column:
            begin = F.get(sums, i) + F.length(F.get(gaps, i))
            before = F.coalesce(F.get(hits, i - 1), F.lit(""))
            after = F.coalesce(F.get(hits, i + 1), F.lit(""))
            return F.struct(
                begin.alias("start"),
                F.lit(kind).alias("kind"),
                (begin + F.length(hit)).alias("end"),
                hit.alias("value"),
                end_of(F.concat(end_of(before), end_of(F.get(gaps, i)))).alias("left"),
                begin_of(F.concat(begin_of(F.get(gaps, i + 1)), begin_of(after))).alias("right"),
            )

        return _let(_running(lengths, _sum), lambda sums: F.transform(hits, lambda hit, i: one(hit, i, sums)))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _let(
        hits,
        lambda hits: F.when(F.size(hits) > 0, _let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps))).otherwise(_no_occurrences()),
    )
    return found if valid is None else F.filter(found, lambda span: valid(span["value"]))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _ip_valid(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card_valid(hit: Column) -> Column:
    """12 to 19 digits with a Luhn sum divisible by ten."""
    digits = F.reverse(_digits(hit))

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(digits, at, F.lit(1)).cast("int")
        twice = F.when(at % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0
    return F.when(F.length(digits).between(12, 19), luhn).otherwise(False)


def _phone_valid(hit: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


def _none() -> Column:
    return F.array().cast(_SPAN)


def _no_occurrences() -> Column:
    return F.array().cast(_OCCURRENCE)


def base_occurrences(text: Column) -> Column:
    """Fixed forms by start and then kind, with what stands around them."""
    numeric = text.rlike("[0-9]")
    none = _no_occurrences()
    return F.array_sort(
        F.concat(
            F.when(F.contains(text, F.lit("@")), occurrences(text, EMAIL, 0)).otherwise(none),
            F.when(numeric, occurrences(text, IP, 1, _ip_valid)).otherwise(none),
            F.when(numeric, occurrences(text, CARD, 2, _card_valid)).otherwise(none),
            F.when(F.contains(text, F.lit("+")), occurrences(text, PHONE, 3, _phone_valid)).otherwise(none),
        )
    )


def _bare(found: Column) -> Column:
    """Spans without their surroundings."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms, by start and then kind."""
    return _bare(base_occurrences(text))


def candidates(text: Column) -> Column:
    """Candidates, with what stands around them."""
    return F.when(text.rlike("[0-9=:#]"), occurrences(text, CANDIDATE, 4)).otherwise(_no_occurrences())


#: Beyond every position.
_FAR = 2**31 - 1


def nodes(found: Column) -> Column:
    """Occurrences with their patterns; ``base`` marks those that overlap a fixed form.

    ``found`` holds fixed forms and candidates by start and kind.  Candidates inside a
    fixed form are left out, the form stands for them.
    """

    def judged(found: Column) -> Column:
        fixed = lambda s: s["kind"] < 4
        ends = _running(F.transform(found, lambda s: F.when(fixed(s), s["end"]).otherwise(0)), _most)
        back = F.transform(F.reverse(found), lambda s: F.when(fixed(s), F.lit(_FAR) - s["start"]).otherwise(0))
        starts = F.reverse(_running(back, _most))

        def one(s: Column, i: Column, ends: Column, starts: Column) -> Column:
            before, after = F.get(ends, i), F.lit(_FAR) - F.get(starts, i)
            return F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["value"].alias("value"),
                patterns(s["value"], s["left"], s["right"]).alias("patterns"),
                (fixed(s) | (before > s["start"]) | (after < s["end"])).alias("base"),
                (~fixed(s) & (before >= s["end"])).alias("inside"),
            )

        each = _let(ends, lambda ends: _let(starts, lambda starts: F.transform(found, lambda s, i: one(s, i, ends, starts))))
        return F.filter(each, lambda s: ~s["inside"] & (F.size(s["patterns"]) > 0))

    return _let(found, judged)


def shape(value: Column) -> Column:
    """Kind of characters and length of a value."""
    kind = (
        F.when(value.rlike("^[0-9]+$"), "digits")
        .when(value.rlike("^[0-9a-f]+$"), "hex")
        .when(value.rlike("^[0-9A-Z]+$"), "upper")
        .otherwise("mixed")
    )
    return F.concat_ws("/", kind, F.length(value).cast("string"))


def patterns(value: Column, left: Column, right: Column) -> Column:
    """Lexical patterns of an occurrence, each with the kind of its value.

    The label, with separator, also with the exact length of the value, and the leading
    letters; the words around the occurrence if it has a digit.
    """
    label = F.lower(F.regexp_extract(left, r"([A-Za-z_]{2,30})[\x20\t]*[=:#][\x20\t]*[\"']?$", 1))
    letters = F.regexp_extract(value, r"^[A-Z]{3,4}|^[a-z]{2,8}_", 0)
    last = r"([\p{L}\p{N}]++)[^\p{L}\p{N}]*+$"
    first = r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]++)"

    def around(left: Column, right: Column) -> Column:
        l1, r1 = F.regexp_extract(left, last, 1), F.regexp_extract(right, first, 1)
        l2 = F.regexp_extract(left, r"([\p{L}\p{N}]++)[^\p{L}\p{N}]++[\p{L}\p{N}]++[^\p{L}\p{N}]*+$", 1)
        r2 = F.regexp_extract(right, r"^[^\p{L}\p{N}]*+[\p{L}\p{N}]++[^\p{L}\p{N}]++([\p{L}\p{N}]++)", 1)

        def named(name: str, words: list[Column], kind: Column) -> Column:
            present = F.lit(True)
            for word in words:
                present = present & (word != "")
            return F.when(present, F.concat_ws("|", F.lit(name), *words, kind))

        def listed_patterns(kind: Column, exact: Column) -> Column:
            return F.array_compact(
                F.array(
                    named("label", [label], exact),
                    named("label", [label], kind),
                    named("prefix", [letters], exact),
                    *[
                        F.when(value.rlike("[0-9]"), named(name, words, kind))
                        for name, words in (
                            ("left", [l1]),
                            ("left2", [l2, l1]),
                            ("right", [r1]),
                            ("right2", [r1, r2]),
                            ("both", [l1, r1]),
                        )
                    ],
                )
            )

        return _let(shape(value), lambda exact: listed_patterns(F.substring_index(exact, "/", 1), exact))

    return around(F.lower(left), F.lower(right))


def _scored_patterns(edges: DataFrame, rounds: int) -> DataFrame:
    """Score and number of distinct values of each pattern after some turns."""
    values = edges.select("value", F.col("seed").cast("double").alias("score"))
    scores = None
    for turn in range(rounds):
        best = values.groupBy("value").agg(F.max("score").alias("score"))
        joined = edges.join(best, "value")
        scores = stored(
            joined.groupBy("pattern").agg(F.avg("score").alias("worth"), F.count("*").alias("n_values")),
            "pii-patterns",
        )
        if turn + 1 < rounds:
            known = look_up(edges, scores, ["pattern"], F.col("value"))
            passed = F.when((F.col("worth") >= CONFIDENT) & (F.col("n_values") >= LEAST_VALUES), F.col("worth"))
            values = known.select(
                "value", F.greatest(F.col("seed").cast("double"), F.coalesce(passed, F.lit(0.0))).alias("score")
            )
    return scores


def found(
    docs: DataFrame,
    carry: list[str] | None = None,
    rounds: int = ROUNDS,
    seed_labels: tuple[str, ...] = SEED_LABELS,
) -> DataFrame:
    """Struct ``row`` of the carried columns (all by default), ``base`` and ``spans``.

    Both are arrays of structs start, kind (number in ``KINDS``), end, value, sorted by
    start and kind; ``spans`` also has the identifiers the patterns extract outside the
    fixed forms.  ``seed_labels`` are labels whose values are known from the start; none
    is needed.  Null texts count as empty and have none.  Texts are searched whole;
    repeated rows are reported each; an empty table gives none; columns with clashing
    names stay inside ``row``.
    """
    inner = spread(docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text")))

    def both(base: Column) -> Column:
        around = nodes(F.array_sort(F.concat(base, candidates(F.col("text")))))
        return F.struct(_bare(base).alias("base"), around.alias("nodes"))

    table = stored(
        inner.withColumn("found", _let(base_occurrences(F.col("text")), both)).select(
            "row", F.monotonically_increasing_id().alias("uid"), "found.base", "found.nodes"
        ),
        "pii",
    )
    each = table.select("uid", F.inline("nodes"))
    places = each.select("uid", "start", "end", "value", "base", F.explode("patterns").alias("pattern"))
    label = F.regexp_extract("pattern", r"^label\|([^|]*)\|", 1)
    labelled = label.isin(*seed_labels) & F.col("value").rlike("[0-9]") if seed_labels else F.lit(False)
    seeded = F.col("base") | labelled | F.col("value").rlike(KEY)
    edges = stored(places.groupBy("pattern", "value").agg(F.max(seeded).alias("seed")), "pii-edges")
    best = _scored_patterns(edges, rounds).where(
        (F.col("worth") >= CONFIDENT) & (F.col("n_values") >= LEAST_VALUES)
    )
    new = look_up(
        places.where(~F.col("base") & ~labelled),
        best.select("pattern", "worth"),
        ["pattern"],
        F.col("value"),
        "inner",
    ).drop("worth")
    new = new.unionByName(places.where(~F.col("base") & labelled))
    span = F.struct("start", F.lit(4).alias("kind"), "end", "value")
    extra = new.groupBy("uid").agg(F.array_sort(F.collect_set(span)).alias("extra"))
    spans = F.array_sort(F.concat("base", F.coalesce("extra", _none())))
    return table.join(extra, "uid", "left").select("row", "base", spans.alias("spans"))


def one_if(kind: int):
    """Function that gives 1 for a span of the kind, else null."""
    return lambda span: F.when(span["kind"] == kind, 1)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


#: Code points of a block of text while masking.
_BLOCK = 4096


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans
    the first names the place, and all their characters go."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(blocks: Column, begin: Column, end: Column) -> Column:
        """Characters from begin to end, of which only the blocks they lie in are read."""
        first, last = F.floor(begin / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
        at, until = F.pmod(begin, F.lit(_BLOCK)), F.pmod(end, F.lit(_BLOCK))
        head = F.coalesce(F.get(blocks, first), F.lit(""))
        tail = F.coalesce(F.get(blocks, last), F.lit(""))
        apart = F.concat(
            F.substr(head, at + 1, F.lit(_BLOCK)),
            F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.left(tail, until),
        )
        return F.when(end <= begin, "").when(first == last, F.substr(head, at + 1, end - begin)).otherwise(apart)

    def replaced(blocks: Column, spans: Column) -> Column:
        def one(span: Column, before: Column) -> Column:
            kept = F.concat(cut(blocks, before, span["start"]), F.get(names, span["kind"]))
            return F.when(span["start"] >= before, kept).otherwise("")

        ends = F.transform(spans, lambda s: s["end"])
        pieces = F.zip_with(spans, _running(ends, _most), one)
        rest = cut(blocks, F.array_max(ends), F.length(text))
        return F.concat(F.array_join(pieces, ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return _let(
        spans,
        lambda spans: F.when(
            F.size(spans) > 0, _let(blocks, lambda blocks: replaced(blocks, spans))
        ).otherwise(text),
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in text and n_chars renewed where it exists.

    A null text stays null.
    """
    table = found(docs)
    table = table.select(
        "row", masked(F.col("row.text"), F.col("spans")).alias("masked"), (F.size("spans") > 0).alias("changed")
    )
    text, changed = F.col("masked"), F.col("changed")
    columns = []
    for name in docs.columns:
        value = F.col("row")[name]
        if name == "text":
            value = text
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            value = F.when(changed, F.length(text).cast(kind)).otherwise(value)
        columns.append(value.alias(name))
    return table.select(*columns)
