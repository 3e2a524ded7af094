"""The same queries as DuckDB SQL over the same tables, as an independent check.

Fragments are shared between strings, never with the Spark code, except for the
SQL expressions of ``inputs`` that spell out request texts for both engines.
"""

from __future__ import annotations

from parley import fixed_values as fixed
from parley.plans import inputs

ORACLE: dict[str, str] = {}

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(value) for value in values) + "]"


def strip(value: str) -> str:
    return f"trim({value}, {SPACE})"


def words(value: str) -> str:
    return rf"list_filter(string_split_regex({value}, '\s+'), lambda w: w <> '')"


PAIRS = """turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
  SELECT conv_id * 4294967296 + turn AS row_id, conv_id, turn, text AS input, next_text AS output
  FROM turns WHERE role = 'user' AND next_role = 'assistant')"""

DIRTY = rf"""{PAIRS},
split AS (SELECT *, {words('output')} AS ow FROM pairs),
dirty AS (
  SELECT row_id, conv_id, turn, input, CASE row_id % 7
    WHEN 0 THEN ''
    WHEN 1 THEN array_to_string(ow[1:2], ' ')
    WHEN 2 THEN repeat(array_to_string(ow[1:4], ' ') || ' ', 6)
    WHEN 3 THEN 'http://'
    WHEN 4 THEN regexp_replace(output, '[.!?;:,]+\z', '') || ' the'
    WHEN 5 THEN input ELSE output END AS output
  FROM split)"""


def flags(source: str, min_words: int = fixed.MIN_WORDS) -> str:
    """CTEs ending in ``flagged``: one boolean per rule and the repetition score."""
    closers = text(fixed.CLOSING_MARKS)
    dangling = "|".join(fixed.DANGLING_WORDS)
    return rf"""prepared AS (
  SELECT *, {strip('output')} AS o, {strip('lower(input)')} AS asked, {strip('lower(output)')} AS said,
    {words('output')} AS ow, {words('lower(input)')} AS aw, {words('lower(output)')} AS sw FROM {source}),
joined AS (SELECT row_id, len(sw) AS n, array_to_string(sw, ' ') AS whole,
    unnest(sw) AS w1, generate_subscripts(sw, 1) AS i FROM prepared),
placed AS (
  SELECT *, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3,
    (sum(length(w1) + 1) OVER (PARTITION BY row_id ORDER BY i))::BIGINT AS after
  FROM joined WINDOW o AS (PARTITION BY row_id ORDER BY i)),
repeats AS (
  SELECT row_id,
    count(*) FILTER (i <= n - 3 AND
      contains(substr(whole, after + length(w2) + 2), w1 || ' ' || w2))
    + 2 * count(*) FILTER (i <= n - 5 AND
      contains(substr(whole, after + length(w2) + length(w3) + 3), w1 || ' ' || w2 || ' ' || w3)) AS hits
  FROM placed GROUP BY row_id),
counted AS (
  SELECT prepared.*, coalesce(repeats.hits, 0) AS hits,
    greatest(len(sw) - 3, 0) + greatest(len(sw) - 5, 0) AS places,
    array_to_string(aw[1:8], ' ') AS first_asked, array_to_string(sw[1:8], ' ') AS first_said,
    list_distinct(aw) AS vocabulary,
    trim(ow[len(ow)], {text(".,!?;:'" + chr(34) + ")]}")}) AS last_word
  FROM prepared LEFT JOIN repeats USING (row_id)),
measured AS (
  SELECT *, CASE WHEN length(output) < 10 OR places = 0 THEN 0.0::DOUBLE
    ELSE least(1.0, hits::DOUBLE / places) END AS score FROM counted),
flagged AS (
  SELECT *,
    coalesce(o, '') = '' AS is_empty,
    score > {fixed.REPETITION_THRESHOLD} AS is_repetitive,
    output <> '' AND len(ow) < {min_words} AS is_short,
    output <> '' AND (o = '' OR o IN ('http://', 'https://') OR
      length(regexp_replace(output, '\P{{L}}', '', 'g')) / nullif(length(replace(output, ' ', '')), 0)
        < {fixed.MIN_LETTER_SHARE}) AS is_gibberish,
    output <> '' AND o <> '' AND (regexp_matches(lower(o), ' ({dangling})\z') OR
      (NOT contains({closers}, right(o, 1)) AND len(ow) > 3
       AND regexp_full_match(last_word, '\p{{L}}{{1,2}}'))) AS is_incomplete,
    output <> '' AND input <> '' AND (
      (len(aw) >= 4 AND len(sw) >= 4
        AND starts_with(first_said, left(first_asked, length(first_asked) // 2)))
      OR (length(asked) > 10 AND (contains(said, asked) OR (len(vocabulary) > 3
        AND len(list_intersect(vocabulary, sw)) / len(vocabulary) > {fixed.ECHO_OVERLAP})))) AS is_echo
  FROM measured)"""


def issue_list(rules=("empty", "repetitive", "short", "gibberish", "incomplete", "echo")) -> str:
    cases = ", ".join(f"CASE WHEN is_{r} THEN {text(fixed.ISSUE_TEXT[r])} END" for r in rules)
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


TOTALS_COLUMNS = ", ".join(
    f"count(*) FILTER (is_{rule}) AS {key}" for rule, key in fixed.SUMMARY_KEYS.items()
)


def totals(by: str = "") -> str:
    """CTEs ending in ``totals`` over ``flagged``."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""

    def noted(name: str, share: float, line: str) -> str:
        before, after = line.split("%d")
        return (
            f"CASE WHEN {name} > total_conversations * {share} "
            f"THEN {text(before)} || {name} || {text(after)} END"
        )

    details = ", ".join(
        [
            noted("repetitive_outputs", 0.2, fixed.ADVICE_REPETITIVE),
            noted("empty_outputs", 0, fixed.ADVICE_EMPTY),
            noted("gibberish_outputs", 0.1, fixed.ADVICE_GIBBERISH),
            noted("echo_outputs", 0.1, fixed.ADVICE_ECHO),
            noted("incomplete_outputs", 0.1, fixed.ADVICE_INCOMPLETE),
        ]
    )
    return f"""judged AS (SELECT *, {issue_list()} AS issues FROM flagged),
counts AS (
  SELECT {key}count(*) AS total_conversations,
    count(*) FILTER (len(issues) = 0) AS valid_conversations, {TOTALS_COLUMNS}
  FROM judged {group}),
scored AS (
  SELECT *, total_conversations - valid_conversations AS invalid_conversations,
    coalesce(valid_conversations / nullif(total_conversations, 0), 0.0)::DOUBLE AS quality_score FROM counts),
totals AS (
  SELECT *,
    CASE WHEN quality_score >= 0.7 THEN 'GOOD' WHEN quality_score >= 0.5 THEN 'ACCEPTABLE'
      ELSE 'CRITICAL' END AS verdict,
    (quality_score < 0.5)::INT AS exit_code,
    CASE WHEN total_conversations = 0 THEN {texts([fixed.ADVICE_NO_DATA])}
      ELSE list_concat(CASE WHEN quality_score < 0.5 THEN {texts(fixed.ADVICE_CRITICAL)}
        WHEN quality_score < 0.7 THEN {texts(fixed.ADVICE_WARNING)} ELSE {texts([fixed.ADVICE_OK])} END,
        list_filter([{details}], lambda t: t IS NOT NULL)) END AS advice
  FROM scored)"""


SCORED = f"WITH {DIRTY}, {flags('dirty')}"
SCORED_TOTALS = f"{SCORED}, {totals()}"

ORACLE["pairs"] = f"WITH {PAIRS} SELECT * FROM pairs"
ORACLE["training_text"] = f"""WITH {PAIRS}
SELECT row_id, 'User: ' || input || chr(10) || 'Assistant: ' || output AS text FROM pairs"""
ORACLE["json_log_round_trip"] = ORACLE["training_text"]
ORACLE["get_batch"] = f"""WITH {PAIRS}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM pairs)
SELECT * FROM numbered WHERE position BETWEEN 40 AND 64"""
ORACLE["batch_assignment"] = f"""WITH {PAIRS}, numbered AS (
  SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM pairs)
SELECT row_id, position, position // 4 AS batch_no FROM numbered"""
ORACLE["training_steps"] = f"""WITH {PAIRS}, sized AS (SELECT count(*) AS rows FROM pairs)
SELECT rows, ceil(rows / 4)::BIGINT AS steps_per_epoch, (ceil(rows / 4) * 3)::BIGINT AS planned_steps FROM sized"""
ORACLE["dataset_size"] = f"WITH {PAIRS} SELECT count(*) AS conversations FROM pairs"

# The single rules look at every output, also the empty one.
ORACLE["rule_empty"] = f"{SCORED} SELECT row_id, is_empty AS empty FROM flagged"
ORACLE["rule_repetitive"] = f"{SCORED} SELECT row_id, is_repetitive AS repetitive FROM flagged"
ORACLE["rule_short"] = f"{SCORED} SELECT row_id, len(ow) < 3 AS short FROM flagged"
ORACLE["rule_gibberish"] = f"{SCORED} SELECT row_id, output = '' OR is_gibberish AS gibberish FROM flagged"
ORACLE["rule_incomplete"] = f"{SCORED} SELECT row_id, is_incomplete AS incomplete FROM flagged"
ORACLE["rule_echo"] = f"{SCORED} SELECT row_id, is_echo AS echo FROM flagged"
ORACLE["repetition_scores"] = f"{SCORED} SELECT row_id, score FROM flagged"

DOCUMENTS = """document_pairs AS (
  SELECT doc_id AS row_id, '' AS input, text AS output, lang, source FROM documents)"""
DOCUMENT_FLAGS = f"WITH {DOCUMENTS}, {flags('document_pairs')}"
ORACLE["document_repetition"] = f"{DOCUMENT_FLAGS} SELECT row_id AS doc_id, score FROM flagged"
ORACLE["document_issues"] = f"""{DOCUMENT_FLAGS}, judged AS (SELECT *, {issue_list()} AS list FROM flagged)
SELECT row_id AS doc_id, array_to_string(list, ' | ') AS issues, len(list) = 0 AS is_valid FROM judged"""
ORACLE["quality_by_source"] = f"""{DOCUMENT_FLAGS}, {totals('source')}
SELECT * EXCLUDE (advice), array_to_string(advice, ' | ') AS recommendations FROM totals"""

ORACLE["issues"] = f"""{SCORED}, judged AS (SELECT *, {issue_list()} AS list FROM flagged)
SELECT row_id, array_to_string(list, ' | ') AS issues, len(list) = 0 AS is_valid FROM judged"""
ORACLE["issues_some_rules"] = f"""WITH {DIRTY}, {flags('dirty', 6)},
judged AS (SELECT *, {issue_list(('empty', 'short', 'gibberish', 'echo'))} AS list FROM flagged)
SELECT row_id, array_to_string(list, ' | ') AS issues, len(list) = 0 AS is_valid FROM judged"""
ORACLE["filter_valid"] = f"""{SCORED}, judged AS (SELECT *, {issue_list()} AS list FROM flagged)
SELECT row_id, input, output FROM judged WHERE len(list) = 0"""
ORACLE["quality_report"] = f"""{SCORED_TOTALS}, examples AS (
  SELECT row_id FROM judged WHERE len(issues) > 0 ORDER BY row_id LIMIT 5)
SELECT * EXCLUDE (advice), array_to_string(advice, ' | ') AS recommendations,
  (SELECT string_agg(row_id, ',' ORDER BY row_id) FROM examples) AS example_rows FROM totals"""
LONG = " UNION ALL ".join(
    f"SELECT '{key}' AS issue, {key} AS conversations FROM totals"
    for key in fixed.SUMMARY_KEYS.values()
)
ORACLE["issue_summary"] = f"{SCORED_TOTALS} {LONG}"
ORACLE["issue_display"] = f"""{SCORED_TOTALS}, long AS ({LONG})
SELECT array_to_string(list_transform(string_split(issue, '_'),
  lambda w: upper(w[1]) || w[2:]), ' ') AS issue, conversations FROM long WHERE conversations > 0"""
ORACLE["problematic_examples"] = f"""{SCORED}, judged AS (SELECT *, {issue_list()} AS list FROM flagged)
SELECT row_id AS index, left(input, 100) AS input, left(output, 100) AS output,
  array_to_string(list, ' | ') AS issues FROM judged WHERE len(list) > 0 ORDER BY row_id LIMIT 5"""
ORACLE["recommendations"] = f"""{SCORED_TOTALS}
SELECT (i - 1)::INT AS line_no, advice[i] AS recommendation
FROM (SELECT advice, unnest(range(1, len(advice) + 1)) AS i FROM totals)"""
ORACLE["training_gate"] = f"""{SCORED_TOTALS}
SELECT quality_score, CASE WHEN quality_score < 0.5 THEN 'blocked' WHEN quality_score < 0.7 THEN 'warn'
  ELSE 'go' END AS gate FROM totals"""

# -- scraped text -------------------------------------------------------------

NAMED = f"""named AS (
  SELECT doc_id, {inputs.DOCUMENT_NAME} AS name, text AS content FROM documents)"""


def stem(name: str) -> str:
    return rf"regexp_replace({name}, '^(.+)\.[^.]+$', '\1')"


def topic_from_filename(name: str) -> str:
    spaced = f"replace(replace({stem(name)}, '_', ' '), '-', ' ')"
    bare = rf"regexp_replace(regexp_replace({spaced}, 'https?://', '', 'g'), 'www\.', '', 'g')"
    tidy = strip(rf"regexp_replace({bare}, '\s+', ' ', 'g')")
    return f"upper(left({tidy}, 1)) || substr({tidy}, 2)"


def topic_from_content(content: str) -> str:
    lines = f"list_transform(string_split({strip(content)}, chr(10)), lambda l: {strip('l')})"
    title = (
        f"list_filter({lines}[1:10], lambda l: l <> '' AND NOT starts_with(l, '#') "
        f"AND length(l) < 100 AND len({words('l')}) < 15)[1]"
    )
    longer = f"list_filter({lines}, lambda l: length(l) > 10)[1]"
    return (
        f"coalesce({title}, CASE WHEN length({longer}) > 100 THEN left({longer}, 100) || '...' "
        f"ELSE {longer} END, 'this topic')"
    )


def source_of(name: str) -> str:
    base = stem(name)
    scheme = rf"nullif(regexp_extract(lower({base}), 'https?[_\-](?:www[_\-.])?([a-zA-Z0-9]+)', 1), '')"
    dotted = rf"nullif(regexp_extract({base}, '\b([a-zA-Z0-9-]+)(?:[_.][a-zA-Z]+)\b', 1), '')"
    first = rf"string_split_regex({base}, '[_\-\s]+')[1]"

    def named(part: str) -> str:
        return f"CASE WHEN lower({part}) NOT IN ('http', 'https', 'www') THEN {part} END"

    return (
        f"coalesce({scheme}, {named(dotted)}, CASE WHEN {base} <> '' THEN {named(first)} END, "
        "'unknown source')"
    )


def clean(content: str) -> str:
    lines = rf"regexp_replace({content}, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')"
    blanks = rf"regexp_replace({lines}, '[ \t]+', ' ', 'g')"
    cookies = f"regexp_replace({blanks}, '(?i)Cookie Policy.*?Accept', '', 'g')"
    return strip(f"regexp_replace({cookies}, '(?i)Subscribe to newsletter', '', 'g')")


def without_title(content: str) -> str:
    first = strip(f"string_split({content}, chr(10))[1]")
    return (
        f"CASE WHEN contains({content}, chr(10)) AND length({first}) < 150 AND NOT ends_with({first}, '.') "
        f"THEN substr({content}, position(chr(10) IN {content}) + 1) ELSE {content} END"
    )


def labels(cleaned: str) -> tuple[str, str]:
    count = f"len({words(cleaned)})"
    kinds = " ".join(
        f"WHEN {count} < {bound} THEN {text(label)}" if bound else f"ELSE {text(label)}"
        for bound, label in fixed.CONTENT_TYPES
    )
    groups = " ".join(
        "WHEN "
        + " OR ".join(f"contains(lower({cleaned}), {text(word)})" for word in keywords)
        + f" THEN {text(name)}"
        for name, keywords in fixed.CATEGORIES
    )
    return f"CASE {kinds} END", f"CASE {groups} ELSE {text(fixed.NO_CATEGORY)} END"


TEMPLATE_NO = "(('0x' || substr(md5('7' || name), 1, 8))::BIGINT % 15)::INT"
CONTENT_TYPE, CATEGORY = labels("cleaned")
DESCRIBED = f"""{NAMED}, stripped AS (
  SELECT *, {topic_from_content('content')} AS content_topic, {without_title('content')} AS body FROM named),
cleaned AS (SELECT *, {clean('body')} AS cleaned FROM stripped),
described AS (
  SELECT doc_id, name, content, cleaned,
    CASE WHEN content_topic = 'this topic' OR length(content_topic) < 5
      THEN {topic_from_filename('name')} ELSE content_topic END AS topic,
    {source_of('name')} AS source, {CONTENT_TYPE} AS content_type, {CATEGORY} AS category,
    {TEMPLATE_NO} AS template_no, length({strip('content')}) < 50 AS too_short
  FROM cleaned)"""

ORACLE["topic_from_content"] = f"""WITH {NAMED}
SELECT doc_id, {topic_from_content('content')} AS topic FROM named"""
ORACLE["topic_from_filename"] = f"WITH {NAMED} SELECT doc_id, {topic_from_filename('name')} AS topic FROM named"
ORACLE["document_source"] = f"WITH {NAMED} SELECT doc_id, {source_of('name')} AS source FROM named"
ORACLE["page_source"] = f"""WITH named AS (
  SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') || '.txt' AS name FROM pages)
SELECT page_id, {source_of('name')} AS source, {topic_from_filename('name')} AS topic FROM named"""
ORACLE["clean_content"] = f"""WITH {NAMED}, bodies AS (SELECT *, {without_title('content')} AS body FROM named)
SELECT doc_id, {clean('content')} AS cleaned, {clean('body')} AS without_title FROM bodies"""
ORACLE["clean_page_text"] = f"SELECT page_id, {clean('html')} AS cleaned FROM pages"
ORACLE["content_labels"] = f"WITH {DESCRIBED} SELECT doc_id, content_type, category FROM described"
ORACLE["template_choice"] = f"WITH {NAMED} SELECT doc_id, {TEMPLATE_NO} AS template_no FROM named"
FILLED = " ".join(
    f"WHEN {number} THEN replace({text(template)}, '{{topic}}', topic)"
    for number, template in enumerate(fixed.PROMPT_TEMPLATES)
)
ORACLE["scrape_pairs"] = f"""WITH {DESCRIBED}
SELECT doc_id, CASE template_no {FILLED} END AS input, cleaned AS output FROM described WHERE NOT too_short"""
ORACLE["scrape_pairs_template"] = f"""WITH {DESCRIBED}
SELECT doc_id, 'What is ' || topic || ' from ' || source || '? (' || content_type || ', ' || category || ', '
  || name || ')' AS input, cleaned AS output FROM described WHERE NOT too_short"""
ORACLE["scrape_stats"] = f"""SELECT count(*) AS found,
  count(*) FILTER (length({strip('text')}) >= 50) AS processed,
  count(*) FILTER (length({strip('text')}) < 50) AS too_short, 0::BIGINT AS unreadable FROM documents"""

# -- forecast requests --------------------------------------------------------

REQUESTS = f"""spelled AS (
  SELECT event_id, user_id, event_type, ts, value, {inputs.REQUEST_TEXT} AS user_request,
    {inputs.REQUEST_BODY} AS body FROM events),
requests AS (SELECT *, {inputs.MODEL_OUTPUT} AS model_output FROM spelled)"""

LOWERED = "lower(user_request)"
AMOUNT = f"regexp_extract({LOWERED}, '{fixed.DURATION_PATTERN}', 1)"
UNIT = f"regexp_extract({LOWERED}, '{fixed.DURATION_PATTERN}', 2)"
HOURS = f"""CASE WHEN {AMOUNT} = '' THEN 24.0::DOUBLE
  WHEN starts_with({UNIT}, 'day') THEN {AMOUNT}::DOUBLE * 24
  WHEN starts_with({UNIT}, 'min') THEN {AMOUNT}::DOUBLE / 60 ELSE {AMOUNT}::DOUBLE END"""


def mentions(options: list[str]) -> str:
    return rf"regexp_matches({LOWERED}, '\b({'|'.join(options)})\b')"


GUESSED_TARGETS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {mentions(options)} THEN '{name}' END"
    for name, options in fixed.TARGET_KEYWORDS.items()
) + "], lambda t: t IS NOT NULL), ',')"
GUESSED_FORMAT = "CASE " + " ".join(
    f"WHEN {mentions([name])} THEN '{name}'" for name in fixed.FORMATS
) + " ELSE 'table' END"
GUESSED = f"""guessed AS (
  SELECT *, {HOURS} AS g_duration, {GUESSED_FORMAT} AS g_format, {GUESSED_TARGETS} AS g_targets FROM requests)"""
ORACLE["fallback_request"] = f"""WITH {REQUESTS}, {GUESSED}
SELECT event_id, 'sensor_id=1' AS query, g_duration AS duration, 1.0::DOUBLE AS interval,
  g_format AS format, g_targets AS targets FROM guessed"""

# Flat objects only: the first brace pair, read as JSON once quotes, None and
# trailing commas are put right.
EXTRACTED = r"""candidates AS (
  SELECT *, regexp_extract(model_output, '\{[^{}]*\}') AS candidate FROM requests),
extracted AS (
  SELECT *, CASE WHEN candidate = '' THEN NULL WHEN json_valid(candidate) THEN candidate
    ELSE regexp_replace(replace(replace(candidate, chr(39), '"'), 'None', 'null'), ',\s*([}\]])', '\1', 'g')
    END AS request FROM candidates)"""
ORACLE["extracted_json"] = rf"""WITH {REQUESTS}, {EXTRACTED}
SELECT event_id, request ->> '$.query' AS query, request ->> '$.duration' AS duration,
  request ->> '$.format' AS format,
  CASE WHEN request IS NOT NULL THEN NULL WHEN contains(model_output, '{{')
    THEN 'Unbalanced braces — JSON object not closed' ELSE 'No JSON object found in LLM output' END AS parse_error
FROM extracted"""


def validated(source: str, column: str) -> str:
    """CTEs ending in ``validated``."""
    j = column
    return rf"""typed AS (
  SELECT *, trim(coalesce({j} ->> '$.query', 'sensor_id=1')) AS v_query,
    json_type({j}, '$.duration') AS duration_kind, try_cast({j} ->> '$.duration' AS DOUBLE) AS v_duration,
    try_cast({j} ->> '$.interval' AS DOUBLE) AS v_interval, {j} ->> '$.format' AS v_format,
    coalesce(try_cast({j} -> '$.targets' AS VARCHAR[]), []) AS v_targets FROM {source}),
bad AS (
  SELECT *, list_sort(list_filter(v_targets, lambda t: t NOT IN ('temp', 'barometer', 'light', 'humidity'))) AS wrong
  FROM typed),
validated AS (
  SELECT *, CASE
    WHEN duration_kind IS NULL THEN 'Missing required field: ''duration'''
    WHEN v_query = '' THEN '''query'' must be a non-empty string'
    WHEN v_duration IS NULL THEN '''duration'' must be a number'
    WHEN v_duration <= 0 THEN '''duration'' must be a positive number'
    WHEN v_interval <= 0 THEN '''interval'' must be a positive number'
    WHEN v_format NOT IN ('json', 'csv', 'table') THEN
      '''format'' must be one of [''csv'', ''json'', ''table''], got ''' || v_format || ''''
    WHEN len(wrong) > 0 THEN 'Invalid target(s): [''' || array_to_string(wrong, ''', ''')
      || ''']. Must be from [''barometer'', ''humidity'', ''light'', ''temp'']' END AS error
  FROM bad)"""


ORACLE["validate_request"] = f"""WITH {REQUESTS}, {validated('requests', 'body')}
SELECT event_id, CASE WHEN error IS NULL THEN v_query END AS query,
  CASE WHEN error IS NULL THEN v_duration END AS duration,
  CASE WHEN error IS NULL THEN v_interval END AS interval,
  CASE WHEN error IS NULL THEN v_format END AS format,
  CASE WHEN error IS NULL THEN array_to_string(v_targets, ',') END AS targets, error FROM validated"""
ORACLE["resolve_request"] = f"""WITH {REQUESTS}, {EXTRACTED}, {validated('extracted', 'request')},
judged AS (SELECT *, request IS NULL OR error IS NOT NULL AS failed FROM validated),
chosen AS (
  SELECT event_id, failed, CASE WHEN failed THEN 'sensor_id=1' ELSE v_query END AS query,
    CASE WHEN failed THEN {HOURS} ELSE v_duration END AS duration,
    CASE WHEN failed THEN 1.0 ELSE v_interval END::DOUBLE AS interval,
    CASE WHEN failed THEN {GUESSED_FORMAT} ELSE v_format END AS format,
    CASE WHEN failed THEN {GUESSED_TARGETS} ELSE array_to_string(v_targets, ',') END AS targets FROM judged)
SELECT event_id, query, duration, interval, format, targets,
  CASE WHEN failed THEN 'heuristic' ELSE 'model' END AS request_source,
  CASE WHEN duration <= 0 THEN '''duration'' must be a positive number' END AS error FROM chosen"""
ORACLE["parse_query_string"] = f"""WITH queries AS (SELECT event_id, {inputs.SENSOR_QUERY} AS query FROM events),
parts AS (SELECT event_id, query, unnest(string_split(query, ',')) AS part,
  generate_subscripts(string_split(query, ','), 1) AS place FROM queries),
failed AS (SELECT event_id, arg_min(trim(part), place) AS part FROM parts WHERE NOT contains(part, '=') GROUP BY event_id),
entries AS (
  SELECT event_id, place, trim(string_split(part, '=')[1]) AS key, trim(substr(part, position('=' IN part) + 1)) AS text
  FROM parts WHERE event_id NOT IN (SELECT event_id FROM failed)),
last AS (SELECT event_id, key, arg_max(text, place) AS text FROM entries GROUP BY event_id, key)
SELECT event_id, key, text, try_cast(text AS DOUBLE) AS number, NULL::VARCHAR AS query_error FROM last
UNION ALL
SELECT event_id, NULL, NULL, NULL, 'Invalid query pair (no ''=''): ''' || part || '''' FROM failed"""
ORACLE["predictor_units"] = f"""WITH {REQUESTS}, {GUESSED}
SELECT event_id, trunc(g_duration * 60)::BIGINT AS duration_minutes,
  trunc(value / 7 * 3600)::BIGINT AS interval_seconds FROM guessed"""
ORACLE["time_grid"] = f"""WITH {REQUESTS}, {GUESSED}, sized AS (
  SELECT event_id, date_trunc('second', ts) AS start, trunc(g_duration * 60)::BIGINT * 60 AS seconds,
    (1 + event_id % 3) * 3600 AS step_seconds FROM guessed),
steps AS (SELECT *, unnest(range(0, seconds // step_seconds + 1)) AS step FROM sized)
SELECT event_id, step, strftime(start + to_seconds(step * step_seconds), '%Y-%m-%d %H:%M:%S') AS predicted_at
FROM steps"""

PREDICTED = f"""predicted AS (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS datetime,
    {', '.join(f'{rule} AS {name}' for name, rule in inputs.PREDICTION_COLUMNS.items())} FROM events)"""


def csv_line(names) -> str:
    cells = ["datetime"] + [f"coalesce(CAST({name} AS VARCHAR), '')" for name in names]
    return " || ',' || ".join(cells)


def table_line(names) -> str:
    cells = ["datetime"] + [f"coalesce(printf('%12.2f', {name}), '            ')" for name in names]
    return " || '  ' || ".join(cells)


def csv_lines(names) -> str:
    return f"""WITH {PREDICTED} SELECT 0 AS line_kind, '{','.join(['datetime', *names])}' AS line
UNION ALL SELECT 2, {csv_line(names)} FROM predicted"""


def table_header(names) -> str:
    return "  ".join(f"{name:>12}" for name in ["datetime", *names])


ORACLE["predictions_csv"] = csv_lines(fixed.TARGETS)
ORACLE["predictions_csv_targets"] = csv_lines(["humidity", "temp"])
ORACLE["predictions_table"] = f"""WITH {PREDICTED}
SELECT 0 AS line_kind, '{table_header(fixed.TARGETS)}' AS line
UNION ALL SELECT 1, '{'-' * len(table_header(fixed.TARGETS))}'
UNION ALL SELECT 2, {table_line(fixed.TARGETS)} FROM predicted"""
ORACLE["predictions_table_by_sensor"] = f"""WITH {PREDICTED}
SELECT DISTINCT sensor_id, 0 AS line_kind, '{table_header(['temp'])}' AS line FROM predicted
UNION ALL SELECT DISTINCT sensor_id, 1, '{'-' * len(table_header(['temp']))}' FROM predicted
UNION ALL SELECT sensor_id, 2, {table_line(['temp'])} FROM predicted"""
ORACLE["predictions_json"] = f"""WITH {PREDICTED}
SELECT event_id, '{{"datetime": "' || datetime || '", "sensor_id": ' || sensor_id || {
    " || ".join(f"""', "{name}": ' || coalesce(CAST({name} AS VARCHAR), 'null')""" for name in ('temp', 'barometer', 'light', 'humidity'))
} || '}}' AS line FROM predicted"""
ORACLE["report_prompt"] = f"""WITH {PREDICTED}, cells AS (
  SELECT sensor_id, left(datetime, 10) AS day, datetime, {csv_line(['temp'])} AS line FROM predicted)
SELECT sensor_id, day, 'Describe the forecast.' || chr(10) || chr(10) || 'Original request: sensor ' || sensor_id
  || ' on ' || day || chr(10) || chr(10) || 'Forecast data:' || chr(10) || 'datetime,temp' || chr(10)
  || string_agg(line, chr(10) ORDER BY datetime, line) || chr(10) || chr(10) || 'Report:' AS prompt
FROM cells GROUP BY sensor_id, day"""

# -- training rows and generation ---------------------------------------------

ORACLE["token_rows"] = f"""WITH {PAIRS}, framed AS (
  SELECT row_id, hex(encode('User: ' || input || chr(10) || 'Assistant: ' || output)) AS bytes FROM pairs),
ids AS (
  SELECT row_id, list_transform(range(0, least(512, length(bytes) // 2)),
    lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::INT + 3) AS ids FROM framed),
padded AS (SELECT row_id, ids, len(ids) AS used FROM ids)
SELECT row_id, array_to_string(list_resize(ids, 512, 0), ' ') AS input_ids,
  array_to_string(list_transform(range(0, 512), lambda i: CASE WHEN i < used THEN 1 ELSE 0 END), ' ') AS attention_mask,
  array_to_string(list_resize(ids, 512, -100), ' ') AS labels FROM padded"""
ORACLE["prompt_text"] = """SELECT doc_id, 'User: ' || left(text, 4096) || chr(10) || 'Assistant:' AS prompt
FROM documents"""
ORACLE["response_text"] = f"""WITH {PAIRS}
SELECT row_id, {strip("string_split(output, 'Assistant:')[-1]")} AS response FROM pairs"""
ORACLE["batch_generate"] = f"""SELECT doc_id, 'I read ' ||
  len({words("'User: ' || left(text, 4096) || chr(10) || 'Assistant:'")}) || ' words.' AS response FROM documents"""

# -- feedback -----------------------------------------------------------------

EXCHANGES = f"""{PAIRS}, exchanges AS (
  SELECT row_id, conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn >= 4 THEN 'quit' WHEN conv_id % 5 = 4 THEN ''
    ELSE {strip('input')} END AS prompt, output AS response,
    CASE WHEN (conv_id + turn // 2) % 2 = 0 THEN '' ELSE {strip("' Better: ' || input")} END AS correction
  FROM pairs),
open AS (
  SELECT * FROM exchanges e WHERE prompt NOT IN ('', 'quit') AND NOT EXISTS (
    SELECT 1 FROM exchanges q WHERE q.conv_id = e.conv_id AND q.prompt = 'quit' AND q.turn <= e.turn))"""
ORACLE["open_prompts"] = f"WITH {EXCHANGES} SELECT row_id, prompt FROM open"
ORACLE["feedback_label"] = f"""WITH {EXCHANGES}
SELECT row_id, prompt AS input, CASE WHEN correction = '' THEN response ELSE correction END AS output,
  correction = '' AS accepted FROM open"""

FEED = f"""{PAIRS}, feed AS (
  SELECT *, conv_id // 50 AS shard, CASE (conv_id + turn) % 11 WHEN 3 THEN 'malformed' WHEN 5 THEN 'blank'
    WHEN 7 THEN 'keyless' WHEN 9 THEN 'malformed' WHEN 1 THEN 'half' WHEN 2 THEN 'undecodable'
    ELSE 'usable' END AS raw FROM pairs),
kinds AS (
  SELECT * EXCLUDE (input, output, raw), if(raw = 'half', 'half ' || chr(65533), input) AS input,
    if(raw = 'half', CAST(row_id AS VARCHAR), output) AS output, raw, if(raw = 'half', 'usable', raw) AS kind FROM feed),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY row_id) AS line_no FROM kinds),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY row_id) AS line_no
  FROM kinds WHERE kind <> 'blank')"""
ORACLE["feed_records"] = f"""WITH {FEED}
SELECT row_id, input, output, CASE WHEN raw = 'half' THEN NULL WHEN row_id % 2 = 0 THEN 'true' ELSE 'false' END AS accepted
FROM kinds WHERE kind = 'usable'"""
ORACLE["feed_counters"] = f"""WITH {FEED}
SELECT count(*) AS total, 100::BIGINT AS consumed, count(*) - 100 AS new FROM filled"""
ORACLE["jsonl_from_offset"] = f"""WITH {FEED}
SELECT shard, line_no, input, output FROM lines WHERE kind = 'usable' AND line_no > 20"""
ORACLE["jsonl_count_and_load"] = f"""WITH {FEED}
SELECT shard, line_no, input, output, (SELECT count(*) FROM filled) AS total
FROM filled WHERE kind = 'usable' AND line_no > 20"""
ORACLE["jsonl_line_totals"] = f"""WITH {FEED}
SELECT shard, count(*) AS lines, count(*) FILTER (kind <> 'blank') AS filled_lines FROM kinds GROUP BY shard"""
ORACLE["stream_feedback_cycle"] = f"""WITH {FEED}
SELECT 'User: ' || input || chr(10) || 'Assistant: ' || output AS text FROM kinds
WHERE kind = 'usable' AND (SELECT count(*) FROM filled) >= 50"""
ORACLE["feed_line_kinds"] = f"""WITH {FEED} SELECT kind, count(*) AS lines FROM kinds WHERE kind <> 'blank' GROUP BY kind"""
ORACLE["csv_round_trip"] = ORACLE["pairs"].replace("SELECT * FROM pairs", "SELECT row_id, input, output FROM pairs")
ORACLE["json_array_round_trip"] = ORACLE["csv_round_trip"]
ORACLE["jsonl_round_trip"] = ORACLE["csv_round_trip"]
ORACLE["log_append_save"] = f"""WITH {PAIRS}
SELECT 'User: ' || input || chr(10) || 'Assistant: ' || output AS text FROM pairs"""
ORACLE["feedback_append"] = f"""WITH {EXCHANGES}
SELECT prompt AS input, CASE WHEN correction = '' THEN response ELSE correction END AS output,
  correction = '' AS accepted FROM open"""
ORACLE["exchanges_append"] = f"""WITH {EXCHANGES}
SELECT response, prompt AS request_json, 8 + 1 + 12 AS stamp_chars FROM exchanges"""
ORACLE["filtered_output"] = ORACLE["filter_valid"]
ORACLE["union_pairs"] = f"""WITH {PAIRS} SELECT row_id, input, output, NULL::BIGINT AS turn FROM pairs
UNION ALL SELECT row_id, output, input, turn FROM pairs"""
ORACLE["text_folder_stats"] = """WITH named AS (
  SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM documents)
SELECT doc_id, length(content) AS chars, md5(content) AS digest FROM named"""
ORACLE["planned_steps_override"] = f"""WITH {PAIRS} SELECT count(*) AS rows, ceil(count(*) / 4.0)::BIGINT AS steps_per_epoch,
  77::BIGINT AS planned_steps FROM pairs"""
ORACLE["custom_rule"] = f"""WITH {PAIRS} SELECT row_id, contains(lower(output), 'the') AS flagged FROM pairs"""
ORACLE["pairs_large_ids"] = f"""WITH {PAIRS}, large AS (
  SELECT (conv_id - 20) * 8589934592 + conv_id AS conv_id, turn, input, output FROM pairs)
SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM large"""

ORACLE["stream_growing_feed"] = ORACLE["stream_feedback_cycle"]
ORACLE["stream_replayed_batch"] = ORACLE["stream_feedback_cycle"]
ORACLE["log_flushes"] = f"""WITH {PAIRS}, placed AS (
  SELECT conv_id // 10 AS s, row_number() OVER (PARTITION BY conv_id // 10) - 1 AS place,
    count(*) OVER (PARTITION BY conv_id // 10) AS n FROM pairs)
SELECT s::VARCHAR AS session, place // 10 AS flush_no,
  CASE WHEN place // 10 < n // 10 THEN 'count' WHEN s % 2 = 0 THEN 'STOP' ELSE 'FLUSH' END AS cause, count(*) AS rows
FROM placed GROUP BY ALL"""
ORACLE["feedback_by_hour"] = f"""WITH {EXCHANGES}, timed AS (
  SELECT (1704067200 + conv_id * 600 + turn) // 3600 * 3600 AS hour, correction = '' AS accepted, conv_id % 13 = 5 AS late
  FROM exchanges)
SELECT hour, count(*) FILTER (accepted AND NOT late) AS accepted, count(*) FILTER (NOT accepted AND NOT late) AS corrected,
  count(*) FILTER (accepted AND late) AS late_accepted, count(*) FILTER (NOT accepted AND late) AS late_corrected
FROM timed GROUP BY hour"""
ORACLE["path_rank"] = """SELECT doc_id, concat_ws('_', source, lang, doc_id) AS name,
  row_number() OVER (ORDER BY concat_ws('_', source, lang, doc_id)) - 1 AS position FROM documents"""
ORACLE["stamp_text"] = """SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%f') AS stamp FROM events"""
ORACLE["json_array_one_file"] = f"""WITH {PAIRS}
SELECT row_id, input, output, row_number() OVER (ORDER BY row_id) - 1 AS position FROM pairs"""
ORACLE["csv_cells"] = """SELECT doc_id, md5(text) AS digest, lang AS output FROM documents"""
