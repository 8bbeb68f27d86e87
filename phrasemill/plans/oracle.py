"""Independent DuckDB SQL for the registered queries."""

from __future__ import annotations

from phrasemill import fixtures as fx
from phrasemill.functions.lexicon import BACKFILL_RULES, DEFAULT
from phrasemill.operators import annotate, audit, convert, rules
from phrasemill.plans.queries import CONTEXT, STAMP, TEMPLATE
from phrasemill.schemas import LIST_FIELDS, REQUIRED_FIELDS


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def rows(values) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(v)})" for v in values) + ")"


def case_of(value: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in mapping.items())
    return f"CASE {value} {whens} ELSE {value} END"


# ---------------------------------------------------------------- shared relations

EX = fx.EXAMPLES_SQL.replace("@events", "events")
GENERATED = fx.GENERATED_SQL.replace("@part", "part")
EXISTING = fx.EXISTING_SQL.replace("@customer", "customer")
RSP = fx.RESPONSES_SQL.replace("@attempts", "(SELECT event_id, unnest([0, 1, 2]) AS attempt FROM events) a")
DOCS = "SELECT doc_id AS example_id, text AS input FROM documents"
TURNS = "SELECT conv_id, turn, text AS input FROM conversations"

LEX = "[" + ", ".join(f"{{'k': {q(k)}, 'r': {q(a[0])}}}" for k, a in DEFAULT.entries) + "]"
VOCABULARY = strings(DEFAULT.vocabulary)


def folded(text: str) -> str:
    return (
        f"list_reduce(list_prepend({{'k': {text}, 'r': lower({text})}}, {LEX}), lambda a, x: "
        "{'k': CASE WHEN contains(a.r, x.k) THEN regexp_replace(a.k, x.k, x.r, 'gi') ELSE a.k END, 'r': a.r}).k"
    )


def backfilled(text: str) -> str:
    whens = " ".join(
        f"WHEN contains(lower({text}), {q(t)}) THEN replace({text}, {q(old)}, {q(new)})"
        for t, old, new in BACKFILL_RULES
    )
    return (
        f"CASE WHEN len(list_filter({VOCABULARY}, lambda w: contains(lower({text}), w))) > 0 THEN {text} "
        f"{whens} ELSE {text} END"
    )


def converted(rel: str, others: str) -> str:
    return (
        f"SELECT {others}, {backfilled('f')} AS input FROM (SELECT {others}, {folded('input')} AS f FROM ({rel}))"
    )


# Edited JSON text, by tokens: each keeps the white space behind it, and knows for every level the key
# and the container it stands in.

EX_ODD = f"{EX} UNION ALL {fx.ODD_SQL.replace('@events', 'events')}"
TOKEN = r'"(?:[^"\\]|\\.)*"\s*|[\[\]{}:,]\s*|[^\s"\[\]{}:,]+\s*|^\s+'
LEVELS = range(1, 6)


def tokens(ex: str) -> str:
    levels = ", ".join(
        f"last_value(CASE WHEN is_key AND level = {k} THEN key END IGNORE NULLS) OVER w AS key{k}, "
        f"last_value(CASE WHEN is_key AND level = {k} THEN is_last END IGNORE NULLS) OVER w AS last{k}, "
        f"last_value(CASE WHEN opens AND level = {k} THEN tok END IGNORE NULLS) OVER w AS open{k}, "
        f"last_value(CASE WHEN opens AND level = {k} THEN pos END IGNORE NULLS) OVER w AS at{k}"
        for k in LEVELS
    )
    return f"""
SELECT *, min(CASE WHEN {IN_RESULT} AND opens AND level = 3 THEN pos END) OVER (PARTITION BY example_id) AS first_result FROM (
SELECT *, {levels}, lag(tok) OVER w AS before, lead(tok) OVER w AS behind, lead(level) OVER w AS level_behind
FROM (
  SELECT *, is_key AND row_number() OVER (PARTITION BY example_id, is_key, place, key ORDER BY pos DESC) = 1 AS is_last
  FROM (
    SELECT *, CASE WHEN is_key THEN json_extract_string(tok, '$') END AS key,
      last_value(CASE WHEN opens AND level = inner_level THEN pos END IGNORE NULLS) OVER (PARTITION BY example_id, level ORDER BY pos) AS place
    FROM (
      SELECT *, level AS inner_level, tok[1] = '"' AND lead(tok) OVER (PARTITION BY example_id ORDER BY pos) = ':' AS is_key
      FROM (
        SELECT example_id, input, pos, raw, tok, opens,
          CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER p - coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (
            PARTITION BY example_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS level
        FROM (
          SELECT *, rtrim(raw, ' ' || chr(10) || chr(9)) AS tok, tok IN ('[', '{{') AS opens, tok IN (']', '}}') AS closes
          FROM (
            SELECT example_id, input, unnest(parts) AS raw, unnest(range(len(parts))) AS pos
            FROM (SELECT *, regexp_extract_all(output_json, '{TOKEN}') AS parts FROM ({ex}) WHERE {IS_OBJECT})
          )
        ) WINDOW p AS (PARTITION BY example_id ORDER BY pos)
      )
    )
  )
) WINDOW w AS (PARTITION BY example_id ORDER BY pos))"""


IS_OBJECT = "json_valid(output_json) AND json_type(CASE WHEN json_valid(output_json) THEN output_json END) = 'OBJECT'"
IN_RESULT = "key1 = 'discovery_results' AND last1 AND open2 = '[' AND open3 = '{'"


ONE_RESULT = f"{IS_OBJECT} AND json_array_length(CASE WHEN {IS_OBJECT} THEN output_json END, '$.discovery_results') = 1"


def value_of(level: int) -> str:
    """Whether a token begins the value of the last key of its name at a level."""
    return f"last{level} AND before = ':' AND (level = {level} AND NOT opens OR level = {level + 1} AND opens)"


def edited(ex: str, recodes: dict[str, dict[str, dict[str, str]]] | None = None, complete: bool = False,
           puts: dict[str, tuple[str, str]] | None = None) -> str:
    """``(example_id, input, output_json)`` with strings of list items recoded, absent keys appended and
    keys of results set (key -> raw value, condition on the token and its example ``x``)."""
    new = "tok"
    whens = []
    for field, keys in (recodes or {}).items():
        for key, mapping in keys.items():
            pairs = " ".join(f"WHEN {q(a)} THEN {q(chr(34) + b + chr(34))}" for a, b in mapping.items())
            whens.append(
                f"WHEN {IN_RESULT} AND key3 = {q(field)} AND last3 AND open4 = '[' AND open5 = '{{' AND level = 5 AND key5 = "
                f"{q(key)} AND {value_of(5)} AND tok[1] = '\"' THEN CASE json_extract_string(CASE WHEN tok[1] = '\"' THEN tok ELSE '0' END, '$') {pairs} ELSE tok END"
            )
    absent_top, absent_result = [], []
    if complete:
        absent_top = [("intent", "null", "true"), ("discovery_results", "[]", "true")]
        absent_result = [(f, "[]" if f in LIST_FIELDS else "null", "true") for f in REQUIRED_FIELDS]
    inside_put = "false"
    for key, (raw, condition) in (puts or {}).items():
        mine = f"{IN_RESULT} AND key3 = {q(key)} AND last3 AND ({condition})"
        whens.append(f"WHEN {mine} AND {value_of(3)} THEN {raw}")
        inside_put = f"{mine} AND NOT (is_key AND level = 3) AND (level > 3 OR level = 3 AND tok NOT IN (':', ',', '{{', '}}')) AND NOT ({value_of(3)})"
        absent_result.append((key, raw, condition))
    if whens:
        new = f"CASE {' '.join(whens)} ELSE tok END"
    new = f"CASE WHEN {inside_put} THEN '' ELSE {new} END"

    def added(level: int, fields: list[tuple[str, str, str]], where: str) -> str:
        if not fields:
            return "''"
        have = f"(SELECT list(k.key) FROM t k WHERE k.example_id = t.example_id AND k.is_key AND k.level = {level} AND k.place = t.at{level})"
        listed = ", ".join(
            f"CASE WHEN ({condition}) AND NOT coalesce(list_contains({have}, {q(name)}), false) THEN {q(chr(34) + name + chr(34) + ':')} || {raw if condition != 'true' else q(raw)} END"
            for name, raw, condition in fields
        )
        return (
            f"CASE WHEN {where} AND (behind = '}}' AND level_behind = {level}) THEN coalesce(CASE WHEN tok <> '{{' THEN ',' ELSE '' END || "
            f"nullif(array_to_string(list_filter([{listed}], lambda s: s IS NOT NULL), ','), ''), '') ELSE '' END"
        )

    # what is appended stands behind the token before the closing brace
    top = added(1, absent_top, "open1 = '{'")
    result = added(3, absent_result, f"{IN_RESULT} AND (level = 3 OR level = 4)")
    trailing = f"CASE WHEN {inside_put} AND NOT (behind IN (',', '}}') AND level_behind = 3) THEN '' ELSE substr(raw, length(tok) + 1) END"
    if puts:  # white space inside a replaced value goes with it
        first = " OR ".join(f"({IN_RESULT} AND key3 = {q(k)} AND last3 AND ({c}) AND {value_of(3)} AND NOT (behind IN (',', '}}') AND level_behind = 3))" for k, (_, c) in puts.items())
        trailing = f"CASE WHEN {first} THEN '' ELSE {trailing} END"
    return f"""
SELECT x.example_id, x.input, coalesce(o.text, x.output_json) AS output_json FROM ({ex}) x LEFT JOIN (
  WITH t AS MATERIALIZED ({tokens(ex)})
  SELECT example_id, string_agg({new} || {result} || {top} || {trailing}, '' ORDER BY pos) AS text FROM t GROUP BY example_id
) o USING (example_id)"""


def text_at(o: str, key: str) -> str:
    return f"json_extract_string({o}, '$.{key}')"


M_NAME = case_of(text_at("e", "name"), convert.MEASURE_NAMES)
D_NAME = case_of(text_at("e", "name"), convert.DIMENSION_NAMES)
U_PHRASE = case_of(text_at("e", "phrase"), convert.UNMATCHED_PHRASES)
U_TYPE = case_of(text_at("e", "type"), rules.TYPE_FIXES)
RECODES = {
    "measures": {"name": convert.MEASURE_NAMES}, "dimensions": {"name": convert.DIMENSION_NAMES},
    "unmatched_intents": {"phrase": convert.UNMATCHED_PHRASES},
}
TYPES = {"unmatched_intents": {"type": rules.TYPE_FIXES}}

CONVERTED_OUTPUT = edited(EX, RECODES)
CONVERTED_EX = converted(CONVERTED_OUTPUT, "example_id, output_json")
FIXED_EX = edited(EX, TYPES, complete=True)


def steps(ex: str = EX) -> str:
    return (
        "SELECT example_id, input, output_json, unnest(rs) AS r, unnest(range(len(rs))) AS step_no FROM "
        f"(SELECT *, CAST(json_extract(output_json, '$.discovery_results') AS JSON[]) AS rs FROM ({ex}))"
    )


def flat(field: str, ex: str = EX) -> str:
    return (
        "SELECT example_id, input, step_no, r, unnest(xs) AS e, unnest(range(len(xs))) AS item_no FROM "
        f"(SELECT *, CAST(json_extract(r, '$.{field}') AS JSON[]) AS xs FROM ({steps(ex)}))"
    )


def flat_rows(field: str, **columns: str) -> str:
    shown = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT example_id, step_no, item_no, {shown} FROM ({flat(field)})"


MEASURES = dict(name=text_at("e", "name"), calculation=text_at("e", "calculation"),
                original_phrase=text_at("e", "original_phrase"))
DIMENSIONS = dict(name=text_at("e", "name"), filter_value=text_at("e", "filter_value"),
                  original_phrase=text_at("e", "original_phrase"))
UNMATCHED = dict(phrase=text_at("e", "phrase"), type=text_at("e", "type"), reason=text_at("e", "reason"))


def size(field: str) -> str:
    return f"CAST(coalesce(json_array_length(r, '$.{field}'), 0) AS BIGINT)"


# ---------------------------------------------------------------- audit


def contained(words, text: str = "lower(input)") -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def term_rows(rel: str, terms=audit.BI_TERMS) -> str:
    listed = rows([(str(i), q(t)) for i, t in enumerate(terms)])
    return (
        f"SELECT ord, term, (SELECT count(*) FROM ({rel}) WHERE contains(lower(input), term)) AS questions "
        f"FROM {listed} t(ord, term)"
    )


def pattern_rows(rel: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ord, {q(p)} AS pattern, count(*) FILTER (WHERE {contained(words)}) AS questions FROM ({rel})"
        for i, (p, words) in enumerate(audit.PATTERNS.items())
    )


VALID = "json_exists(output_json, '$.intent') AND json_exists(output_json, '$.discovery_results')"


def top_issues(ex: str = EX) -> str:
    return (
        "SELECT example_id, -1 AS step_no, -1 AS field_no, '' AS field, 'Example ' || example_id || CASE WHEN NOT "
        "json_exists(output_json, '$.intent') THEN ': Missing intent field' ELSE ': Missing discovery_results' END "
        f"AS issue FROM ({ex}) WHERE NOT ({VALID})"
    )


def field_issues(ex: str = EX) -> str:
    fields = rows([(str(i), q(f)) for i, f in enumerate(REQUIRED_FIELDS)])
    return (
        "SELECT example_id, step_no, field_no, field, 'Example ' || example_id || ', Result ' || step_no || "
        f"': Missing ' || field AS issue FROM ({steps(ex)}), {fields} f(field_no, field) "
        f"WHERE {VALID} AND NOT json_exists(r, '$.' || field)"
    )


def all_issues(ex: str = EX) -> str:
    return f"{top_issues(ex)} UNION ALL {field_issues(ex)}"


FIRST_RESIDUAL = (
    f"list_filter({strings(audit.NON_BI_TERMS)}, lambda t: contains(lower(input), t))[1]"
)


def residual(ex: str = EX) -> str:
    return (
        "SELECT example_id, term, 'Non-BI term found: ''' || term || ''' in question' AS issue FROM "
        f"(SELECT example_id, {FIRST_RESIDUAL} AS term FROM ({ex})) WHERE term IS NOT NULL"
    )


def flagged(ex: str = EX) -> str:
    return (
        f"SELECT bool_or(contains(lower(input), {q(audit.FLAG_TERM)}) OR contains(lower(output_json), "
        f"{q(audit.FLAG_TERM)})) AS term_present FROM ({ex})"
    )


def metrics(ex: str = EX) -> str:
    def step(s):
        return f"(SELECT count(*) FROM ({steps(ex)}) WHERE {text_at('r', 'step_id')} = '{s}')"

    return (
        f"SELECT count(*) AS n, {step('step_1')} AS s1, {step('step_2')} AS s2, {step('step_3')} AS s3, "
        f"count(*) FILTER (WHERE {VALID}) AS valid, (SELECT count(*) FROM ({all_issues(ex)})) AS output_issues, "
        f"(SELECT count(*) FROM ({residual(ex)})) AS residual_issues, ({flagged(ex)}) AS dataset_flag, "
        f"(SELECT count(*) FROM ({term_rows(ex)}) WHERE questions > 0) AS used FROM ({ex})"
    )


def points(value: str, bounds, rest: int) -> str:
    whens = " ".join(f"WHEN {value} >= {b} THEN {p}" for b, p in bounds)
    return f"CASE {whens} ELSE {rest} END"


def scored(ex: str = EX) -> str:
    ratio, issues = "((s2 + s3) / n::DOUBLE)", "(residual_issues + dataset_flag::INT)"
    parts = {
        "volume_points": points("n", audit.VOLUME_STEPS, 0),
        "complexity_points": f"CASE WHEN {ratio} BETWEEN 0.3 AND 0.7 THEN 20 WHEN {ratio} BETWEEN 0.2 AND 0.8 "
        "THEN 15 ELSE 10 END",
        "term_points": points("used", audit.TERM_STEPS, 0),
        "validity_points": points("(valid / n::DOUBLE)", audit.VALIDITY_STEPS, 0),
        "issue_points": f"CASE WHEN {issues} = 0 THEN 20 WHEN {issues} <= 10 THEN 15 WHEN {issues} <= 50 THEN 10 "
        "ELSE 5 END",
    }
    cells = ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in parts.items())
    return f"SELECT *, {' + '.join(parts)} AS score FROM (SELECT *, {cells} FROM ({metrics(ex)}))"


SCORE = "volume_points, complexity_points, term_points, validity_points, issue_points, CAST(score AS BIGINT) AS score"
VERDICT = "CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' ELSE 'needs work' END AS verdict"


def report(ex: str = EX) -> str:
    terms = term_rows(ex)
    patterns = ", ".join(
        f"(SELECT count(*) FROM ex WHERE {contained(words)}) AS pattern_{p}" for p, words in audit.PATTERNS.items()
    )
    return (
        f"WITH ex AS ({ex}), terms AS ({terms.replace(ex, 'SELECT * FROM ex')}) "
        "SELECT n AS total_examples, s1 AS simple_questions, s2 + s3 AS complex_questions, s2 AS multi_step_questions, "
        "s3 AS three_step_questions, (s2 + s3) / n::DOUBLE AS complexity_ratio, used AS total_terms_used, "
        "(SELECT coalesce(string_agg(term || '=' || questions, ',' ORDER BY questions DESC, ord), '') FROM (SELECT * FROM terms "
        "WHERE questions > 0 ORDER BY questions DESC, ord LIMIT 10)) AS most_common_terms, "
        "(SELECT string_agg(term, ',' ORDER BY ord) FROM terms WHERE questions = 0) AS terms_with_zero_usage, "
        f"{patterns}, valid AS valid_outputs, output_issues, valid / n::DOUBLE AS validity_rate, residual_issues, "
        f"dataset_flag, {SCORE}, {VERDICT} FROM ({scored('SELECT * FROM ex')})"
    )


# ---------------------------------------------------------------- question lists

STRIP = r"regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '')"


def cleaned(rel: str) -> str:
    return (
        f"SELECT line_no, line FROM (SELECT line_no, {STRIP} AS line FROM ({rel})) "
        "WHERE line <> '' AND NOT starts_with(line, '//')"
    )


STRIPPED = rf"SELECT line_no, regexp_replace(line, '^\d+\.\s*', '') AS line FROM ({cleaned(GENERATED)})"
RENUMBERED = (
    "SELECT row_number() OVER (ORDER BY line_no) - 1 AS position, "
    f"(row_number() OVER (ORDER BY line_no) + {60}) || '. ' || line AS line FROM ({STRIPPED})"
)
COMBINED = (
    "SELECT 0::BIGINT AS source, row_number() OVER (ORDER BY line_no) - 1 AS position, line "
    f"FROM ({cleaned(EXISTING)}) UNION ALL SELECT 1::BIGINT, position, line FROM ({RENUMBERED})"
)

# ---------------------------------------------------------------- annotation

PROMPT = (
    f"replace(replace({q(TEMPLATE)}, {q(annotate.QUESTION_MARK)}, input), {q(annotate.CONTEXT_MARK)}, {q(CONTEXT)})"
)
PARSED = (
    "SELECT *, CASE WHEN error IS NOT NULL OR content IS NULL THEN 'error' WHEN json_valid(content) THEN 'ok' "
    f"ELSE 'invalid' END AS kind FROM ({RSP})"
)
OUTCOME = (
    "SELECT example_id, min(attempt) FILTER (WHERE kind = 'ok') AS won, "
    "arg_min(content, attempt) FILTER (WHERE kind = 'ok') AS content, arg_max(kind, attempt) AS last_kind "
    f"FROM ({PARSED}) GROUP BY example_id"
)


def skeleton(text: str) -> str:
    return (
        "'{\"intent\":\"intents_discovery\",\"discovery_results\":[{\"step_id\":\"step_1\",\"sub_question\":' || "
        f"CAST(to_json({text}) AS VARCHAR) || ',\"measures\":[],\"dimensions\":[],\"timegrain\":null,"
        "\"timeframe\":null,\"pattern\":null,\"segments\":[],\"breakdowns\":[],\"unmatched_intents\":[]}]}'"
    )


ANNOTATED = (
    "SELECT e.example_id, e.input, CASE WHEN o.won IS NOT NULL THEN 'model' WHEN o.last_kind = 'invalid' THEN "
    "'skeleton' ELSE 'original' END AS provenance, CASE WHEN o.won IS NOT NULL THEN o.content WHEN o.last_kind = "
    f"'invalid' THEN {skeleton('e.input')} ELSE e.output_json END AS output_json "
    f"FROM ({EX}) e LEFT JOIN ({OUTCOME}) o ON e.example_id = o.example_id"
)
KEPT = (
    f"SELECT e.example_id, e.input, p.content AS output_json FROM ({EX}) e JOIN ({PARSED}) p "
    "ON e.example_id = p.example_id AND p.attempt = 0 AND p.kind = 'ok'"
)


def request(s: annotate.RequestSettings) -> str:
    tail = ",\"response_format\":{\"type\":\"json_object\"}" if s.json_object else ""
    return (
        f"SELECT example_id, {q(s.model)} AS model, {q(s.system)} AS system_message, {PROMPT} AS user_message, "
        f"{s.temperature}::DOUBLE AS temperature, {s.max_tokens}::BIGINT AS max_tokens, "
        f"'{{\"model\":\"{s.model}\",\"messages\":[{{\"role\":\"system\",\"content\":\"{s.system}\"}},"
        f"{{\"role\":\"user\",\"content\":' || CAST(to_json({PROMPT}) AS VARCHAR) || '}}],"
        f"\"temperature\":{s.temperature},\"max_tokens\":{s.max_tokens}{tail}}}' AS request_json FROM ({EX})"
    )


_OK = "'{\"chars\": ' || n || ', \"attempt\": ' || attempt || '}'"
ANNOTATE = (
    f"SELECT example_id, attempt, CASE WHEN n % 4 = 0 AND attempt = 0 THEN NULL WHEN n % 4 = 1 AND attempt < 2 "
    f"THEN '{{' WHEN n % 4 = 2 THEN 'no json' ELSE {_OK} END AS content, "
    "CASE WHEN n % 4 = 0 AND attempt = 0 THEN 'rate_limit' END AS error FROM (SELECT example_id, n, "
    "unnest(range([2, 3, 3, 1][n % 4 + 1])) AS attempt FROM "
    f"(SELECT example_id, length({PROMPT}) AS n FROM ({EX})))"
)

# ---------------------------------------------------------------- rules


def list_has(values, value: str) -> str:
    return f"coalesce(list_contains({strings(values)}, {value}), false)"


def type_issues(ex: str = EX) -> str:
    return (
        f"SELECT example_id, step_no, item_no, {UNMATCHED['phrase']} AS phrase, {UNMATCHED['type']} AS type "
        f"FROM ({flat('unmatched_intents', ex)}) WHERE NOT {list_has(rules.ALLOWED_TYPES, UNMATCHED['type'])}"
    )


def calculation_issues(ex: str = EX) -> str:
    return (
        f"SELECT example_id, step_no, item_no, {MEASURES['name']} AS name, {MEASURES['calculation']} AS calculation "
        f"FROM ({flat('measures', ex)}) WHERE NOT {list_has(rules.ALLOWED_CALCULATIONS, MEASURES['calculation'])}"
    )


def complexity_issues(ex: str = EX) -> str:
    hint = contained(rules.COMPLEXITY_INDICATORS)
    n = "CAST(coalesce(json_array_length(output_json, '$.discovery_results'), 0) AS BIGINT)"
    return (
        f"SELECT example_id, input, {n} AS steps, CASE WHEN {hint} THEN 'under_split' ELSE 'over_split' END AS mismatch "
        f"FROM ({ex}) WHERE ({hint} AND {n} < 2) OR (NOT {hint} AND {n} >= 2)"
    )


def phrase_issues(ex: str = EX) -> str:
    def part(field, kind):
        return (
            f"SELECT example_id, step_no, '{kind}' AS kind, item_no, {text_at('e', 'original_phrase')} AS original_phrase "
            f"FROM ({flat(field, ex)}) WHERE NOT contains(lower(input), lower({text_at('e', 'original_phrase')}))"
        )

    return f"{part('measures', 'measure')} UNION ALL {part('dimensions', 'dimension')}"


def class_rows(ex: str = EX) -> str:
    """One row (class, priority, example) per issue."""
    sources = {
        "structure": all_issues(ex), "invalid_type": type_issues(ex), "complexity": complexity_issues(ex),
        "original_phrase": phrase_issues(ex), "calculation": calculation_issues(ex),
    }
    return " UNION ALL ".join(
        f"SELECT {q(name)} AS issue_class, example_id FROM ({sql})" for name, sql in sources.items()
    )


def priorities(ex: str = EX) -> str:
    classes = rows([(q(c), q(p)) for c, p in rules.PRIORITIES.items()])
    return (
        f"SELECT c.issue_class, c.priority, count(i.example_id) AS issues, count(DISTINCT i.example_id) AS examples, "
        f"count(DISTINCT i.example_id) / (SELECT count(*) FROM ({ex}))::DOUBLE AS example_share "
        f"FROM {classes} c(issue_class, priority) LEFT JOIN ({class_rows(ex)}) i ON i.issue_class = c.issue_class "
        "GROUP BY c.issue_class, c.priority"
    )


QUALITY_RATE = (
    f"SELECT n AS examples, i AS issues, 1 - i / n::DOUBLE AS quality_rate FROM (SELECT (SELECT count(*) FROM ({EX})) "
    f"AS n, (SELECT count(*) FROM ({class_rows()})) AS i)"
)
CALC_LISTS = " ".join(f"WHEN {q(w)} THEN {strings(c)}" for w, c in rules.CALCULATION_WORDS.items())

# ---------------------------------------------------------------- fixes of words, phrases and steps

WORD = r"[\pL\pN]+"
SAID = (
    "SELECT example_id, input, step_no, 'measure' AS kind, item_no, "
    f"{text_at('e', 'original_phrase')} AS phrase, {text_at('e', 'calculation')} AS calculation FROM ({flat('measures')}) UNION ALL "
    f"SELECT example_id, input, step_no, 'dimension', item_no, {text_at('e', 'original_phrase')}, NULL FROM ({flat('dimensions')})"
)
TRIGGER = "CASE " + " ".join(
    f"WHEN list_contains({strings(names)}, calculation) AND contains(lower(input), {q(word)}) THEN "
    f"substr(input, CAST(instr(lower(input), {q(word)}) AS INTEGER), {len(word)})"
    for word, names in rules.CALCULATION_WORDS.items()
) + " END"
MENDED = rf"""
WITH said AS ({SAID}), asked AS (
  SELECT DISTINCT input, phrase, regexp_extract_all(lower(input), '{WORD}') AS w,
    regexp_extract_all(input, '{WORD}[^\pL\pN]*') AS spelled, list_distinct(regexp_extract_all(lower(phrase), '{WORD}')) AS p
  FROM said WHERE NOT contains(lower(input), lower(phrase))
), tried AS (
  SELECT *, 2000000 * len(list_intersect(w[i:i + n - 1], p)) // (n + len(p)) AS score
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest(range(1, least(len(w), 2 * len(p)) + 1)) AS n FROM asked))
), best AS (
  SELECT input, phrase, regexp_replace(array_to_string(spelled[i:i + n - 1], ''), '[^\pL\pN]+$', '') AS better FROM tried
  WHERE score >= {rules.LEAST_LIKENESS} * 10000 QUALIFY row_number() OVER (PARTITION BY input, phrase ORDER BY score DESC, i, n) = 1
)
SELECT example_id, input, step_no, kind, item_no, CASE WHEN NOT contains(lower(input), lower(s.phrase)) THEN coalesce(better, {TRIGGER}, s.phrase)
  ELSE s.phrase END AS original_phrase FROM said s LEFT JOIN best USING (input, phrase)
"""
JOINED = f"""
SELECT example_id, step_no, unnest(range(len(runs))) AS item_no, unnest(runs) AS x FROM (
  SELECT example_id, step_no, list_reduce(list_prepend(CAST([] AS STRUCT(p VARCHAR, t VARCHAR, r VARCHAR, many BOOLEAN)[]), list_transform(items, lambda v: [v])),
    lambda done, one: CASE WHEN len(done) > 0 AND NOT contains(one[1].p, ' ') AND (done[-1].many OR NOT contains(done[-1].p, ' '))
      AND contains(low, lower(done[-1].p || ' ' || one[1].p))
      THEN list_append(done[:-2], struct_pack(p := done[-1].p || ' ' || one[1].p, t := done[-1].t, r := done[-1].r, many := true))
      ELSE list_concat(done, one) END) AS runs
  FROM (
    SELECT example_id, step_no, lower(any_value(input)) AS low, list(struct_pack(p := {UNMATCHED['phrase']}, t := {UNMATCHED['type']},
      r := {UNMATCHED['reason']}, many := false) ORDER BY item_no) AS items FROM ({flat('unmatched_intents')}) GROUP BY example_id, step_no
  )
)"""
LISTS = ("measures", "dimensions", "pattern", "segments", "breakdowns", "unmatched_intents")
PLANTED = (
    "SELECT example_id, input, CASE example_id % 10 WHEN 4 THEN replace(output_json, '\"dimensions\":[{', "
    "'\"dimensions\":[\"Country\",{') WHEN 5 THEN replace(output_json, '\"discovery_results\":[', "
    f"'\"discovery_results\":[7,') ELSE output_json END AS output_json FROM ({EX})"
)
SKIPPED = (
    f"WITH s AS ({steps(PLANTED)}) "
    "SELECT example_id, step_no, 'discovery_results' AS field, CAST(-1 AS BIGINT) AS item_no, r ->> '$' AS element FROM s "
    "WHERE json_type(r) <> 'OBJECT' UNION ALL SELECT example_id, step_no, field, item_no, e ->> '$' FROM ("
    + " UNION ALL ".join(
        f"SELECT example_id, step_no, '{f}' AS field, unnest(xs) AS e, unnest(range(len(xs))) AS item_no FROM "
        f"(SELECT *, CAST(json_extract(r, '$.{f}') AS JSON[]) AS xs FROM s WHERE json_type(r) = 'OBJECT')"
        for f in ("measures", "dimensions", "pattern", "unmatched_intents"))
    + ") WHERE json_type(e) <> 'OBJECT'"
)


def flat_steps(ex: str) -> str:
    counts = ", ".join(f"{size(f)} AS n_{f}" for f in LISTS)
    return (
        f"SELECT example_id, step_no, {text_at('r', 'step_id')} AS step_id, {text_at('r', 'sub_question')} AS "
        "sub_question, json_extract_string(r, '$.timegrain.phrase') AS timegrain, json_extract_string(r, "
        f"'$.timeframe.phrase') AS timeframe, {counts} FROM ({steps(ex)})"
    )


HINTED = contained(rules.COMPLEXITY_INDICATORS)


def merged_steps() -> str:
    """``flatten_steps`` of the examples, the results of questions without an indicator being one."""
    one = f"NOT {HINTED}"
    place = f"CASE WHEN {one} THEN 0 ELSE step_no END"
    counts = ", ".join(
        f"CAST(len(list_distinct(flatten(list(coalesce(CAST(json_extract(r, '$.{f}') AS VARCHAR[]), []) ORDER BY step_no)))) AS BIGINT) AS n_{f}"
        for f in LISTS
    )
    first = lambda path: f"first({path} ORDER BY step_no) FILTER (WHERE {path} IS NOT NULL)"
    return (
        f"SELECT example_id, {place} AS step_no, {first(text_at('r', 'step_id'))} AS step_id, {first(text_at('r', 'sub_question'))} AS sub_question, "
        f"{first(text_at('r', 'timegrain.phrase'))} AS timegrain, {first(text_at('r', 'timeframe.phrase'))} AS timeframe, {counts} "
        f"FROM ({steps()}) GROUP BY example_id, {place}"
    )


def slotted(text: str, quoted: str) -> str:
    filled = f"list_reduce(list_prepend({text}, vs), lambda t, v: replace(t, v, '<v>'))"
    return f"regexp_replace(regexp_replace({filled}, {q(quoted)}, '<q>', 'g'), {q(rules._NUMBER)}, '<n>', 'g')"


DRIFT_EX = steps(converted(EX, "example_id, output_json"))
ALIGNED = f"""
SELECT example_id, step_no, sub, a, b, unnest(range(1, len(a) + 1)) AS place, unnest(a) AS was, unnest(b) AS is_ FROM (
  SELECT example_id, step_no, {text_at('r', 'sub_question')} AS sub, regexp_extract_all(input, '{WORD}') AS a,
    regexp_extract_all({text_at('r', 'sub_question')}, '{WORD}') AS b FROM ({DRIFT_EX})
) WHERE len(a) = len(b)"""
DRIFT = f"""
WITH r AS (SELECT example_id, step_no, list_distinct(regexp_extract_all(lower(input), '{WORD}')) AS a,
    list_distinct(regexp_extract_all(lower({text_at('r', 'sub_question')}), '{WORD}')) AS b FROM ({DRIFT_EX}) WHERE {text_at('r', 'sub_question')} IS NOT NULL),
m AS (SELECT lower(was) AS was, lower(is_) AS is_, count(DISTINCT (example_id, step_no)) AS n FROM ({ALIGNED}) WHERE lower(was) <> lower(is_)
  GROUP BY ALL HAVING count(DISTINCT (example_id, step_no)) >= {rules.DRIFT_SUPPORT}),
qa AS (SELECT w, count(*) AS n FROM (SELECT unnest(a) AS w FROM r) GROUP BY w),
qb AS (SELECT w, count(*) AS n FROM (SELECT unnest(b) AS w FROM r) GROUP BY w)
SELECT was AS in_question, is_ AS in_sub_question, m.n AS results, qa.n AS question_results, qb.n AS sub_results,
  m.n * 1000 // qa.n AS confidence, m.n * 1000 * (SELECT count(*) FROM r) // (qa.n * qb.n) AS lift
FROM m JOIN qa ON qa.w = was JOIN qb ON qb.w = is_ WHERE m.n * 1000 // qa.n >= {rules.DRIFT_CONFIDENCE}"""
PREMIUM = (
    "contains(lower(input), 'premium customers') AND coalesce(list_contains(list_transform(json_extract_string(e, "
    "['$.name', '$.filter_value', '$.original_phrase']), lambda v: lower(v)), 'premium customers'), false)"
)
REMOVED = (
    f"SELECT example_id, step_no, item_no FROM ({flat('dimensions')}) WHERE {PREMIUM} OR "
    f"coalesce(list_contains(json_extract_string(r, '$.breakdowns[*].name'), {text_at('e', 'name')}), false)"
)
REPAIRED = f"""
SELECT issue_class, a.issues AS issues_before, CASE issue_class WHEN 'calculation' THEN a.issues WHEN 'complexity' THEN
  (SELECT count(*) FROM ({EX}) WHERE {HINTED} AND coalesce(json_array_length(output_json, '$.discovery_results'), 0) < 2)
  WHEN 'original_phrase' THEN (SELECT count(*) FROM ({MENDED}) WHERE NOT contains(lower(input), lower(original_phrase)) AND NOT
    (kind = 'dimension' AND (example_id, step_no, item_no) IN ({REMOVED}))) ELSE 0 END AS issues_after
FROM ({priorities()}) a"""


ORACLE: dict[str, str] = {
    "read_examples": f"SELECT row_number() OVER (ORDER BY example_id) - 1 AS example_id, input, output_json FROM ({EX})",
    "write_examples": f"SELECT row_number() OVER (ORDER BY example_id) - 1 AS example_id, input, output_json "
    f"FROM ({CONVERTED_EX})",
    "write_report": report(),
    "read_lines": cleaned(
        f"SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, line FROM ({GENERATED})"
    ),
    "write_lines": f"SELECT row_number() OVER (ORDER BY source, position) - 1 AS line_no, line FROM ({COMBINED})",
    "load_context": (
        "WITH c AS (SELECT chr(10) || chr(10) || '[part-00000.json]' || chr(10) || string_agg('{\"n_nationkey\":' || "
        "n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' || chr(10), '' "
        f"ORDER BY n_nationkey) AS context FROM nation), p AS (SELECT example_id, replace(replace({q(TEMPLATE)}, "
        f"{q(annotate.QUESTION_MARK)}, input), {q(annotate.CONTEXT_MARK)}, context) AS prompt FROM ({EX}), c) "
        "SELECT example_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM p"
    ),
    "load_template": (
        f"SELECT example_id, replace({q(TEMPLATE + ' ')}, {q(annotate.QUESTION_MARK)}, input) AS prompt, "
        f"{len(TEMPLATE) + 1}::BIGINT AS template_chars FROM ({EX})"
    ),
    "repair_concat_json": (
        f"SELECT row_number() OVER (ORDER BY example_id) - 1 AS example_id, input, output_json FROM ({EX})"
    ),
    "lexicon_table": (
        "SELECT l.ord::BIGINT AS ord, l.key, l.repl, l.alternates, t.questions FROM "
        + rows([(str(i), q(k), q(a[0]), q(",".join(a))) for i, (k, a) in enumerate(DEFAULT.entries)])
        + f" l(ord, key, repl, alternates) JOIN ({term_rows(EX, DEFAULT.terms)}) t ON t.ord = l.ord"
    ),
    "lexicon_vocabulary": f"SELECT term AS word, questions FROM ({term_rows(EX, DEFAULT.vocabulary)})",
    "lexicon_rewrite": f"SELECT example_id, {folded('input')} AS input FROM ({EX})",
    "lexicon_rewrite_documents": f"SELECT example_id, {folded('input')} AS input FROM ({DOCS})",
    "context_backfill": f"SELECT example_id, {backfilled('input')} AS input FROM ({EX})",
    "convert_question": converted(EX, "example_id"),
    "convert_question_documents": converted(DOCS, "example_id"),
    "convert_question_conversations": converted(TURNS, "conv_id, turn"),
    "recode_measures": flat_rows("measures", **{**MEASURES, "name": M_NAME}),
    "recode_dimensions": flat_rows("dimensions", **{**DIMENSIONS, "name": D_NAME}),
    "recode_unmatched": flat_rows("unmatched_intents", **{**UNMATCHED, "phrase": U_PHRASE}),
    "convert_output": f"SELECT example_id, output_json FROM ({edited(EX_ODD, RECODES)})",
    "convert_examples": converted(edited(EX_ODD, RECODES), "example_id, output_json"),
    "unreadable_outputs": (
        f"SELECT example_id, content AS output_json FROM ({RSP}) WHERE content IS NOT NULL AND NOT json_valid(content)"
    ),
    "typed_output": (
        "SELECT example_id, json_extract_string(output_json, '$.intent') AS intent, CAST(json_array_length("
        "json_extract(output_json, '$.discovery_results')) AS BIGINT) AS results, array_to_string(list_filter("
        "json_keys(output_json), lambda k: k NOT IN ('intent', 'discovery_results')), ',') AS extra_keys "
        f"FROM ({ANNOTATED})"
    ),
    "conversion_preview": (
        f"SELECT e.example_id, e.input AS original, c.input AS converted FROM ({EX}) e JOIN "
        f"({converted(EX, 'example_id')}) c ON c.example_id = e.example_id ORDER BY e.example_id LIMIT 5"
    ),
    "conversion_progress": (
        f"SELECT example_id // 1000 * 1000 AS processed, count(*) AS examples FROM ({EX}) GROUP BY 1"
    ),
    "skipped_elements": SKIPPED,
    "flatten_steps": flat_steps(EX),
    "stored_steps": flat_steps(PLANTED) + " WHERE json_type(r) = 'OBJECT'",
    "stored_skipped": SKIPPED,
    "flatten_measures": flat_rows("measures", **MEASURES),
    "flatten_dimensions": flat_rows("dimensions", **DIMENSIONS),
    "flatten_unmatched": flat_rows("unmatched_intents", **UNMATCHED),
    "step_distribution": (
        f"SELECT s.step_id, count(t.example_id) AS results FROM {rows([(q(s),) for s in audit.STEP_IDS])} s(step_id) "
        f"LEFT JOIN ({steps()}) t ON {text_at('t.r', 'step_id')} = s.step_id GROUP BY s.step_id"
    ),
    "complexity_summary": (
        "SELECT s1 AS simple_questions, s2 + s3 AS complex_questions, s2 AS multi_step_questions, s3 AS "
        f"three_step_questions, (s2 + s3) / n::DOUBLE AS complexity_ratio FROM ({metrics()})"
    ),
    "term_counts": f"SELECT term, questions FROM ({term_rows(EX)})",
    "term_counts_documents": f"SELECT term, questions FROM ({term_rows(DOCS)})",
    "terms_used": f"SELECT count(*) AS terms_used FROM ({term_rows(EX)}) WHERE questions > 0",
    "top_terms": f"SELECT term, questions FROM ({term_rows(EX)}) WHERE questions > 0 ORDER BY questions DESC, ord LIMIT 10",
    "terms_unused": f"SELECT term FROM ({term_rows(EX)}) WHERE questions = 0",
    "question_patterns": f"SELECT pattern, questions FROM ({pattern_rows(EX)})",
    "question_patterns_documents": f"SELECT pattern, questions FROM ({pattern_rows(DOCS)})",
    "question_pattern_flags": "SELECT example_id, "
    + ", ".join(f"{contained(words)} AS is_{p}" for p, words in audit.PATTERNS.items())
    + f" FROM ({EX})",
    "pattern_ranking": (
        f"SELECT pattern, questions, questions / (SELECT count(*) FROM ({EX}))::DOUBLE AS share FROM "
        f"({pattern_rows(EX)}) WHERE questions > 0 ORDER BY questions DESC, ord LIMIT 10"
    ),
    "structure_issues_top": f"SELECT example_id, issue FROM ({top_issues()})",
    "structure_issues_fields": f"SELECT example_id, step_no, field, issue FROM ({field_issues()})",
    "structure_issues": f"SELECT example_id, issue FROM ({all_issues()})",
    "validity_rate": f"SELECT valid AS valid_outputs, valid / n::DOUBLE AS validity_rate FROM ({metrics()})",
    "residual_terms": residual(),
    "residual_term_summary": (
        f"SELECT issue, count(*) AS issues FROM ({residual()}) GROUP BY issue UNION ALL "
        f"SELECT {q(audit.FLAG_ISSUE)}, 1::BIGINT FROM ({flagged()}) WHERE term_present"
    ),
    "dataset_term_flag": flagged(),
    "issue_sample": (
        f"SELECT example_id, issue, greatest((SELECT count(*) FROM ({all_issues()})) - 5, 0) AS remaining "
        f"FROM ({all_issues()}) ORDER BY example_id, step_no, field_no LIMIT 5"
    ),
    "overall_statistics": (
        "SELECT n AS total_examples, valid AS valid_outputs, valid / n::DOUBLE AS validity_rate, s1 AS "
        "simple_questions, s1 / n::DOUBLE AS simple_share, s2 + s3 AS complex_questions, (s2 + s3) / n::DOUBLE AS "
        f"complex_share FROM ({metrics()})"
    ),
    "quality_score": f"SELECT {SCORE} FROM ({scored()})",
    "quality_verdict": f"SELECT CAST(score AS BIGINT) AS score, {VERDICT} FROM ({scored()})",
    "quality_report": report(),
    "quality_report_converted": report(CONVERTED_EX),
    "strip_numbering": STRIPPED,
    "renumber": RENUMBERED,
    "combine_questions": COMBINED,
    "write_examples_array": f"SELECT row_number() OVER (ORDER BY example_id) - 1 AS example_id, input, output_json FROM ({EX})",
    "write_rejects": (
        "SELECT 'answer ' || example_id AS input, content AS output_json, CASE WHEN content IS NULL THEN 'no output' "
        f"WHEN NOT json_valid(content) THEN 'output is not JSON' END AS problem FROM ({RSP})"
    ),
    "slice_range": (
        f"SELECT 'middle' AS slice, example_id, input FROM ({EX}) WHERE example_id >= 100 AND example_id < 700 UNION ALL "
        f"SELECT 'end', example_id, input FROM ({EX}) WHERE example_id >= (SELECT count(*) FROM events) - 250"
    ),
    "assign_batches": f"SELECT example_id, example_id // 5 AS batch_no FROM ({EX})",
    "render_prompt": f"SELECT example_id, input, {PROMPT} AS prompt FROM ({EX})",
    "request_rows": request(annotate.BATCH),
    "request_rows_interactive": request(annotate.INTERACTIVE),
    "annotate_batches": ANNOTATE,
    "incremental_annotate": (
        "SELECT example_id, input, CASE n % 4 WHEN 2 THEN 'skeleton' ELSE 'model' END AS provenance, CASE n % 4 WHEN 2 THEN "
        f"{skeleton('input')} ELSE '{{\"chars\": ' || n || ', \"attempt\": ' || CASE n % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END "
        f"|| '}}' END AS output_json FROM (SELECT *, length({PROMPT}) AS n FROM ({EX}))"
    ),
    "parse_response": f"SELECT example_id, attempt::BIGINT AS attempt, content, error, kind FROM ({PARSED})",
    "resolve_attempts": (
        f"SELECT example_id, won::BIGINT AS attempt, content FROM ({OUTCOME}) WHERE won IS NOT NULL"
    ),
    "fallback_skeleton": f"SELECT example_id, input, output_json FROM ({ANNOTATED}) WHERE provenance = 'skeleton'",
    "fallback_original": f"SELECT example_id, input, output_json FROM ({ANNOTATED}) WHERE provenance = 'original'",
    "annotated_dataset": ANNOTATED,
    "drop_failures": KEPT,
    "retry_schedule": (
        "SELECT p.example_id, p.attempt::BIGINT AS attempt, p.kind, CASE WHEN p.kind = 'error' AND p.attempt < 2 THEN "
        f"pow(2.0::DOUBLE, p.attempt) ELSE 0.0::DOUBLE END AS delay_seconds FROM ({PARSED}) p JOIN ({OUTCOME}) o ON "
        "o.example_id = p.example_id WHERE o.won IS NULL OR p.attempt <= o.won"
    ),
    "annotation_summary": (
        "SELECT example_id, CASE WHEN json_exists(output_json, '$.intent') THEN json_extract_string(output_json, "
        "'$.intent') ELSE 'N/A' END AS intent, CAST(json_array_length(json_extract(output_json, "
        f"'$.discovery_results')) AS BIGINT) AS steps FROM ({KEPT})"
    ),
    "annotation_totals": (
        f"SELECT (SELECT count(*) FROM ({KEPT})) AS processed, (SELECT count(*) FROM ({EX})) AS examples"
    ),
    "stamp_results": (
        f"SELECT example_id, input AS question, output_json AS response, {q(annotate.LOCAL.model)} AS model, "
        f"{q(STAMP + '.000000')} AS timestamp FROM ({KEPT})"
    ),
    "prompt_sizes": (
        f"SELECT {len(TEMPLATE)}::BIGINT AS template_chars, {len(CONTEXT)}::BIGINT AS context_chars, min(n) AS "
        "min_prompt_chars, sum(n) / count(*)::DOUBLE AS avg_prompt_chars, max(n) AS max_prompt_chars FROM "
        f"(SELECT length({PROMPT}) AS n FROM ({EX}))"
    ),
    "incremental_convert": CONVERTED_EX,
    "incremental_convert_lines": (
        f"SELECT input, output_json, CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS VARCHAR) AS record FROM ({CONVERTED_EX}) WHERE "
        "example_id % 50 NOT BETWEEN 7 AND 11 UNION ALL SELECT NULL, NULL, CASE k WHEN 7 THEN 'not a JSON object' WHEN 8 THEN "
        "'no input' WHEN 9 THEN 'no output' ELSE 'output is no object that can be edited' END, CASE k WHEN 7 THEN 'no record ' || "
        "example_id WHEN 8 THEN '{\"output\":' || CAST(to_json(output_json) AS VARCHAR) || '}' WHEN 9 THEN '{\"input\":\"' || input || "
        "'\"}' ELSE '{\"input\":\"' || input || '\",\"output\":\"[' || example_id || ']\"}' END FROM "
        f"(SELECT *, example_id % 50 AS k FROM ({EX})) WHERE k BETWEEN 7 AND 10"
    ),
    "union_datasets": (
        f"SELECT 'events' AS source, example_id AS source_id, example_id, input, output_json FROM ({EX}) UNION ALL "
        "SELECT 'questions', line_no, line_no + (SELECT max(event_id) + 1 FROM events), line, "
        f"{skeleton('line')} FROM ({STRIPPED})"
    ),
    "fix_types": flat_rows("unmatched_intents", **{**UNMATCHED, "type": U_TYPE}),
    "fix_types_text": f"SELECT example_id, output_json FROM ({edited(EX_ODD, TYPES)})",
    "complete_fields": f"SELECT example_id, output_json FROM ({edited(EX_ODD, complete=True)})",
    "invalid_types": type_issues(),
    "invalid_calculations": calculation_issues(),
    "complexity_mismatch": complexity_issues(),
    "phrase_mismatch": phrase_issues(),
    "sub_question_mismatch": (
        f"SELECT example_id, input, {text_at('r', 'sub_question')} AS sub_question FROM ({steps()}) WHERE "
        f"json_array_length(output_json, '$.discovery_results') = 1 AND {text_at('r', 'sub_question')} <> input"
    ),
    "count_measure_name": (
        f"SELECT example_id, step_no, item_no, {M_NAME} AS name, {MEASURES['calculation']} AS calculation FROM "
        f"({flat('measures')}) WHERE {MEASURES['calculation']} = 'Count' AND {M_NAME} IS DISTINCT FROM 'Count'"
    ),
    "count_measure_name_fix": flat_rows(
        "measures",
        **{**MEASURES, "name": f"CASE WHEN {MEASURES['calculation']} = 'Count' THEN 'Count' ELSE {M_NAME} END"},
    ),
    "unknown_term_audit": (
        f"SELECT {UNMATCHED['type']} AS type, count(*) AS intents FROM ({flat('unmatched_intents')}) GROUP BY 1"
    ),
    "unknown_term_reclass": flat_rows(
        "unmatched_intents",
        **{
            **UNMATCHED,
            "type": f"CASE WHEN {UNMATCHED['type']} = 'unknown_term' AND "
            f"{list_has(rules.BUSINESS_PHRASES, 'lower(' + UNMATCHED['phrase'] + ')')} THEN 'business_entity' "
            f"ELSE {UNMATCHED['type']} END",
        },
    ),
    "split_phrases": (
        "SELECT example_id, step_no, item_no, phrase || ' ' || next AS phrase FROM (SELECT example_id, input, step_no, "
        f"item_no, {UNMATCHED['phrase']} AS phrase, lead({UNMATCHED['phrase']}) OVER (PARTITION BY example_id, step_no "
        f"ORDER BY item_no) AS next FROM ({flat('unmatched_intents')})) WHERE NOT contains(phrase, ' ') AND NOT "
        "contains(next, ' ') AND contains(lower(input), lower(phrase || ' ' || next))"
    ),
    "split_phrases_fix": f"SELECT example_id, step_no, item_no, x.p AS phrase, x.t AS type, x.r AS reason FROM ({JOINED})",
    "original_phrase_fix": f"SELECT example_id, step_no, kind, item_no, original_phrase FROM ({MENDED})",
    "complexity_fix": merged_steps(),
    "entity_drift_learned": DRIFT,
    "entity_drift_fix": (
        f"SELECT s.example_id, s.step_no, coalesce(f.text, {text_at('s.r', 'sub_question')}) AS sub_question FROM ({DRIFT_EX}) s LEFT JOIN ("
        f"SELECT example_id, step_no, string_agg(CASE WHEN d.results IS NOT NULL THEN was ELSE is_ END || regexp_extract(p, '[^\\pL\\pN]*$'), '' "
        f"ORDER BY place) AS text FROM (SELECT *, regexp_extract_all(sub, '{WORD}[^\\pL\\pN]*')[place] AS p FROM ({ALIGNED})) x LEFT JOIN ({DRIFT}) d ON "
        "d.in_question = lower(was) AND d.in_sub_question = lower(is_) GROUP BY example_id, step_no) f USING (example_id, step_no)"
    ),
    "before_after_repair": (
        "SELECT *, CASE WHEN issues_before > 0 THEN (issues_before - issues_after) / issues_before::DOUBLE * 100 END AS "
        f"improvement_pct FROM ({REPAIRED})"
    ),
    "entity_drift": (
        "SELECT p.in_question, p.in_sub_question, count(s.example_id) AS results FROM "
        + rows([(q(a), q(b)) for a, b in rules.DRIFT_PAIRS])
        + f" p(in_question, in_sub_question) LEFT JOIN ({steps(converted(EX, 'example_id, output_json'))}) s ON "
        f"contains(lower(s.input), p.in_question) AND contains(lower({text_at('s.r', 'sub_question')}), "
        "p.in_sub_question) GROUP BY ALL"
    ),
    "calculation_mismatch": (
        f"SELECT x.example_id, w.word FROM ({EX}) x, {rows([(q(w),) for w in rules.CALCULATION_WORDS])} w(word) WHERE "
        f"contains(lower(x.input), w.word) AND NOT EXISTS (SELECT 1 FROM ({flat('measures')}) m WHERE m.example_id = "
        f"x.example_id AND list_contains(CASE w.word {CALC_LISTS} END, {text_at('m.e', 'calculation')}))"
    ),
    "breakdown_confusion": (
        f"SELECT example_id, step_no, {size('dimensions')} AS n_dimensions FROM ({steps()}) WHERE contains(lower(input), "
        f"' by ') AND {size('dimensions')} > 0 AND {size('breakdowns')} = 0"
    ),
    "redundant_dimensions": (
        f"SELECT example_id, step_no, item_no, {text_at('e', 'name')} AS name FROM ({flat('dimensions')}) WHERE "
        f"list_contains(json_extract_string(r, '$.breakdowns[*].name'), {text_at('e', 'name')})"
    ),
    "redundant_dimensions_fix": (
        "SELECT example_id, step_no, row_number() OVER (PARTITION BY example_id, step_no ORDER BY item_no) - 1 AS "
        f"item_no, {DIMENSIONS['name']} AS name, {DIMENSIONS['filter_value']} AS filter_value, "
        f"{DIMENSIONS['original_phrase']} AS original_phrase FROM ({flat('dimensions')}) WHERE NOT coalesce("
        f"list_contains(json_extract_string(r, '$.breakdowns[*].name'), {text_at('e', 'name')}), false)"
    ),
    "missing_timeframe": (
        rf"SELECT example_id, regexp_extract(input, '{rules.TIME_PHRASE}', 1) AS phrase FROM ({EX}) x WHERE "
        rf"regexp_extract(input, '{rules.TIME_PHRASE}', 1) <> '' AND NOT EXISTS (SELECT 1 FROM ({steps()}) s WHERE "
        "s.example_id = x.example_id AND json_extract_string(s.r, '$.timeframe.phrase') IS NOT NULL)"
    ),
    "sub_question_fix": "SELECT example_id, output_json FROM (" + edited(EX_ODD, puts={"sub_question": (
        "CAST(to_json(input) AS VARCHAR)",
        f"example_id IN (SELECT example_id FROM ({EX_ODD}) WHERE {ONE_RESULT})")}) + ")",
    "timeframe_fix": "SELECT example_id, output_json FROM (" + edited(EX_ODD, puts={"timeframe": (
        f"'{{{chr(34)}phrase{chr(34)}:{chr(34)}' || regexp_extract(input, '{rules.TIME_PHRASE}', 1) || '{chr(34)}}}'",
        rf"regexp_extract(input, '{rules.TIME_PHRASE}', 1) <> '' AND at3 = first_result AND NOT EXISTS (SELECT 1 FROM t c WHERE "
        f"c.example_id = t.example_id AND {IN_RESULT.replace('key', 'c.key').replace('last', 'c.last').replace('open', 'c.open')} AND "
        "c.key3 = 'timeframe' AND c.last3 AND c.level = 4 AND c.key4 = 'phrase' AND c.before = ':' AND c.tok <> 'null')")}) + ")",
    "premium_move": (
        "SELECT example_id, step_no, row_number() OVER (PARTITION BY example_id, step_no ORDER BY item_no) - 1 AS item_no, "
        f"{DIMENSIONS['name']} AS name, {DIMENSIONS['filter_value']} AS filter_value, {DIMENSIONS['original_phrase']} AS "
        f"original_phrase FROM ({flat('dimensions')}) WHERE NOT ({PREMIUM})"
    ),
    "premium_reclass": (
        flat_rows("unmatched_intents", **UNMATCHED)
        + " UNION ALL SELECT example_id, step_no, "
        f"{size('unmatched_intents')} AS item_no, 'premium customers', 'business_entity', 'listed business phrase' "
        f"FROM ({steps()}) WHERE contains(lower(input), 'premium customers') "
        "AND NOT coalesce(list_contains(list_transform(CAST(json_extract_string(r, '$.unmatched_intents[*].phrase') "
        "AS VARCHAR[]), lambda p: lower(p)), 'premium customers'), false)"
    ),
    "exact_duplicates": (
        f"SELECT min(example_id) AS kept_id, count(*) AS copies FROM ({EX}) GROUP BY input, output_json "
        "HAVING count(*) > 1"
    ),
    "exact_duplicates_documents": (
        f"SELECT min(example_id) AS kept_id, count(*) AS copies FROM ({DOCS}) GROUP BY input HAVING count(*) > 1"
    ),
    "drop_duplicates": (
        f"SELECT min(example_id) AS example_id, input FROM ({EX}) GROUP BY input, output_json"
    ),
    "conflicting_duplicates": (
        "SELECT input, min(example_id) AS first_id, count(*) AS examples, count(DISTINCT output_json) AS outputs "
        f"FROM ({EX}) GROUP BY input HAVING count(DISTINCT output_json) > 1"
    ),
    "conflicting_templates": (
        f"SELECT template, min(example_id) AS first_id, count(*) AS examples, count(DISTINCT shape) AS shapes FROM (SELECT example_id, "
        f"{slotted('input', rules._QUOTED)} AS template, {slotted('output_json', rules._QUOTED_INSIDE)} AS shape FROM (SELECT x.*, coalesce(v.vs, []) AS vs "
        f"FROM ({EX}) x LEFT JOIN (SELECT example_id, list({DIMENSIONS['filter_value']} ORDER BY step_no, item_no) AS vs FROM ({flat('dimensions')}) "
        f"WHERE {DIMENSIONS['filter_value']} <> '' GROUP BY example_id) v USING (example_id))) GROUP BY template HAVING count(DISTINCT shape) > 1"
    ),
    "intent_coverage": (
        f"SELECT i.intent, count(x.example_id) AS examples FROM {rows([(q(i),) for i in rules.INTENTS])} i(intent) "
        f"LEFT JOIN ({EX}) x ON json_extract_string(x.output_json, '$.intent') = i.intent GROUP BY i.intent"
    ),
    "issue_priorities": priorities(),
    "data_quality_rate": QUALITY_RATE,
    "before_after": (
        "SELECT issue_class, a.issues AS issues_before, b.issues AS issues_after, CASE WHEN a.issues > 0 THEN "
        f"(a.issues - b.issues) / a.issues::DOUBLE * 100 END AS improvement_pct FROM ({priorities()}) a "
        f"FULL JOIN ({priorities(FIXED_EX)}) b USING (issue_class)"
    ),
    "readiness_gate": f"SELECT quality_rate, quality_rate > {rules.READY_RATE} AS ready FROM ({QUALITY_RATE})",
    "clean_subset": (
        f"SELECT example_id, input, output_json FROM ({EX}) WHERE example_id NOT IN (SELECT example_id FROM "
        f"({class_rows()})) ORDER BY example_id LIMIT {rules.SUBSET_SIZE}"
    ),
}
