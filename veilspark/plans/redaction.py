"""Queries of the redaction operators and their SQL counterparts, for the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import candidate_id, letters
from veilspark.operators import audit, detect, governance, mapping, planning, redact, release, review
from veilspark.operators.rules import DICTIONARY_PREFIX, IMPACT, RULES, SOFTENED, STRATEGIES, TECHNICAL_SIGNAL, S
from veilspark.session import load, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- SQL fragments ------------------------------------------------------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    space = S[:-1]
    return f"regexp_replace({x}, {lit(f'^{space}+|{space}+$')}, '', 'g')"


def sql_clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({sql_strip(x)}, {lit(f'^(?:为|是){S}')}, ''), '^[ ：:，,。；;]+|[ ：:，,。；;]+$', '', 'g')"


def sql_found(rule, text: str = "text") -> str:
    """The list of a rule's values in a text. Words are cut out first where a rule must stand alone, as the engine has no lookahead."""
    flags = "(?i)" if rule.flags else ""
    if rule.sort == "word":
        return f"list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, {lit(flags + '(?:' + rule.core + ')')}))"
    if rule.sort == "edge":
        return f"regexp_extract_all({text}, {lit(flags + '(?:^|[^\\p{L}\\p{N}_])(' + rule.core + ')(?:$|[^\\p{L}\\p{N}_])')}, 1)"
    if rule.name == "amount":
        return f"regexp_extract_all({text}, {lit('(?:^|[^A-Za-z0-9])(' + rule.core.replace('(?<![A-Za-z0-9])', '') + ')')}, 1)"
    core = rule.core if rule.sort == "label" else f"({rule.core})"
    return f"regexp_extract_all({text}, {lit(flags + core)}, 1)"


def sql_values(rule, text: str = "text") -> str:
    clean = sql_clean("x") if rule.sort == "label" else sql_strip("x")
    return f"list_filter(list_transform({sql_found(rule, text)}, lambda x: {clean}), lambda x: x <> '')"


def sql_amount_range(x: str) -> str:
    n = f"try_cast(translate(regexp_extract({x}, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?'), '０１２３４５６７８９', '0123456789') AS DOUBLE)"
    scaled = f"CASE WHEN contains({x}, '亿元') THEN {n} * 10000 WHEN contains({x}, '万元') THEN {n} WHEN contains({x}, '元') THEN {n} / 10000 WHEN contains({x}, '$') OR contains(lower({x}), 'usd') OR contains(lower({x}), 'dollar') THEN {n} * 7.2 / 10000 WHEN contains(lower({x}), 'rmb') OR contains(lower({x}), 'cny') THEN {n} / 10000 ELSE {n} END"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN ({scaled}) IS NULL THEN '金额区间未知' WHEN ({scaled}) < 10 THEN '低于10万' WHEN ({scaled}) < 50 THEN '10万至50万' WHEN ({scaled}) < 100 THEN '50万至100万' WHEN ({scaled}) < 500 THEN '100万至500万' WHEN ({scaled}) < 1000 THEN '500万至1000万' WHEN ({scaled}) < 5000 THEN '1000万至5000万' ELSE '高于5000万' END"


def sql_letters(n: str) -> str:
    """Letters of a number, by the lengths up to six; greater numbers than 321272406 have none in the SQL."""
    first = lambda m: sum(26**i for i in range(m))
    at = lambda m, i: f"chr(CAST(65 + (({n} - {first(m)}) // {26 ** (m - 1 - i)}) % 26 AS INTEGER))"
    return "CASE " + " ".join(f"WHEN {n} < {first(m + 1)} THEN {' || '.join(at(m, i) for i in range(m))}" for m in range(1, 7)) + " END"


def sql_profile(kind: str, i: int, default: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{p[i]}'" for k, p in IMPACT.items()) + f" ELSE '{default}' END"


_ID = "substr(sha256(kind || '|' || original), 1, 16)"
_ENTITIES = "e AS (SELECT DISTINCT project_id, ord, kind, original, placeholder_prefix, strategy, replacement_hint FROM entities WHERE original <> '' AND kind IS NOT NULL)"
_DECISIONS = f"d AS (SELECT project_id, candidate_id, max(struct_pack(a := CASE WHEN action IN ('redact', 'keep') THEN action ELSE 'redact' END, s := CASE WHEN strategy IN ({', '.join(map(lit, STRATEGIES))}) THEN strategy END)) AS x FROM decisions WHERE candidate_id IS NOT NULL GROUP BY 1, 2)"
_DECIDED = f"{_ENTITIES}, {_DECISIONS}, ed AS (SELECT e.*, {_ID} AS candidate_id FROM e), dec AS (SELECT ed.*, d.x.a AS d_action, d.x.s AS d_strategy, coalesce(d.x.a, '') = 'keep' OR (strategy = 'keep' AND coalesce(d.x.a, '') <> 'redact') AS kept FROM ed LEFT JOIN d USING (project_id, candidate_id))"
_MAPPING = f"{_DECIDED}, num AS (SELECT *, row_number() OVER (PARTITION BY project_id, placeholder_prefix ORDER BY ord, kind, original) AS seq, coalesce(d_strategy, CASE WHEN strategy = 'keep' THEN 'mask' ELSE strategy END) AS s FROM dec WHERE NOT kept), items AS (SELECT project_id, ord, candidate_id, kind, original, coalesce(placeholder_prefix, '') || {sql_letters('seq')} AS placeholder, s AS strategy, strategy AS default_strategy, CASE WHEN s = 'range' THEN replacement_hint END AS preservation_value FROM num), m AS (SELECT project_id, ord, candidate_id, kind, original, placeholder, CASE WHEN preservation_value <> '' THEN placeholder || '（' || preservation_value || '）' ELSE placeholder END AS replacement, strategy, default_strategy, preservation_value FROM items)"
_IMPACTS = f"{_MAPPING}, first AS (SELECT project_id, candidate_id, kind, min_by(strategy, ord) AS strategy, min_by(coalesce(d_strategy, strategy), ord) AS shown FROM dec GROUP BY ALL), im AS (SELECT f.project_id, f.candidate_id, f.kind, CASE WHEN m.candidate_id IS NOT NULL THEN 'redact' ELSE 'keep' END AS action, CASE WHEN m.candidate_id IS NOT NULL THEN m.strategy ELSE f.shown END AS strategy, {sql_profile('f.kind', 0, 'other')} AS impact_domain, CASE WHEN m.candidate_id IS NOT NULL THEN {sql_profile('f.kind', 1, 'low')} ELSE 'none' END AS base FROM first f LEFT JOIN (SELECT project_id, candidate_id, max(strategy) AS strategy FROM m GROUP BY 1, 2) m USING (project_id, candidate_id)), impacts AS (SELECT project_id, candidate_id, kind, action, strategy, impact_domain, CASE WHEN base = 'none' THEN 'none' WHEN kind = 'amount' AND strategy = 'range' THEN 'low' WHEN kind IN ({', '.join(map(lit, SOFTENED))}) AND strategy = 'pseudonym' THEN 'low' ELSE base END AS impact_level FROM im)"
_SCORE = "CASE impact_level WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 1 END"


def _entities(spark, d) -> DataFrame:
    return load(spark, d, "entities").select("project_id", "ord", "kind", "original", "placeholder_prefix", "strategy", "replacement_hint").distinct()


def _mapped(spark, d) -> DataFrame:
    return mapping.build_mapping(_entities(spark, d), load(spark, d, "decisions"))


def _impacts(spark, d) -> DataFrame:
    return audit.impact_items(_entities(spark, d), _mapped(spark, d), load(spark, d, "decisions"))


# ---- detection ----------------------------------------------------------------------------------------------------------------------


def _rule_query(rule):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return detect.rule_hits(spread(load(spark, d, "documents").select("doc_id", "text")), "text", rule).groupBy("doc_id", "original").agg(F.count("*").alias("n"))

    run.__doc__ = f"Values of the rule {rule.name} in documents, with their number."
    return run


for _rule in RULES:
    QUERIES[f"detect_{_rule.name}"] = _rule_query(_rule)
    SQL[f"detect_{_rule.name}"] = f"SELECT doc_id, original, count(*) AS n FROM (SELECT doc_id, unnest({sql_values(_rule)}) AS original FROM documents WHERE text IS NOT NULL) GROUP BY ALL"


@query("technical_signal", f"SELECT doc_id, regexp_matches(coalesce(text, ''), {lit(TECHNICAL_SIGNAL)}) AS signal FROM documents")
def technical_signal(spark, d):
    """Which documents speak of technical results."""
    return load(spark, d, "documents").select("doc_id", detect.technical_signal(F.col("text")).alias("signal"))


_ALL = " UNION ALL ".join(
    f"SELECT project_id, doc_id, {i} AS rule_ord, unnest(range(1, len(v) + 1)) AS match_ord, '{r.kind}' AS kind, '{r.prefix}' AS placeholder_prefix, '{r.strategy}' AS strategy, unnest(v) AS original, {'true' if r.name == 'amount' else 'false'} AS ranged FROM (SELECT project_id, doc_id, {sql_values(r)} AS v FROM documents WHERE text IS NOT NULL)"
    for i, r in enumerate(RULES)
)


@query(
    "detected_entities",
    f"WITH f AS ({_ALL}), o AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind, original ORDER BY doc_id, rule_ord, match_ord) AS rn FROM f) SELECT project_id, kind, original, placeholder_prefix, strategy, CASE WHEN ranged THEN {sql_amount_range('original')} END AS replacement_hint FROM o WHERE rn = 1",
)
def detected_entities(spark, d):
    """Entities of each project's documents, the first occurrence giving their attributes."""
    return detect.detect(spread(load(spark, d, "documents").select("project_id", "doc_id", "text")), ["project_id"], "doc_id", "text")


@query(
    "entity_order",
    "SELECT project_id, kind, original, row_number() OVER (PARTITION BY project_id ORDER BY length(original) DESC, kind, original) AS ord FROM (SELECT DISTINCT project_id, kind, original FROM entities WHERE original <> '')",
)
def entity_order(spark, d):
    """Entities in the order in which replacement claims text."""
    e = load(spark, d, "entities").filter("original <> ''").select("project_id", "kind", "original").distinct()
    return detect.ordered(e, ["project_id"])


@query("amount_range_buckets", f"SELECT DISTINCT entity_id, {sql_amount_range('original')} AS bucket FROM entities WHERE kind = 'amount'")
def amount_range_buckets(spark, d):
    """The bucket of every amount."""
    return load(spark, d, "entities").filter("kind = 'amount'").select("entity_id", detect.amount_range(F.col("original")).alias("bucket")).distinct()


_PREFIX = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in DICTIONARY_PREFIX.items()) + " ELSE '自定义' END"
_VALUES = f"v AS (SELECT DISTINCT project_id, kind, {sql_strip('value')} AS value FROM dictionary WHERE kind IS NOT NULL AND length({sql_strip('value')}) > 0)"


@query("dictionary_values", f"WITH {_VALUES} SELECT project_id, kind, value, {_PREFIX} AS placeholder_prefix FROM v")
def dictionary_values(spark, d):
    """The customers' dictionaries, cleaned."""
    return detect.dictionary_values(load(spark, d, "dictionary"))


@query("dictionary_entities", f"WITH {_VALUES} SELECT project_id, kind, value, {_PREFIX} AS placeholder_prefix FROM v WHERE EXISTS (SELECT 1 FROM documents t WHERE t.project_id = v.project_id AND contains(t.text, v.value))")
def dictionary_entities(spark, d):
    """Dictionary values that stand in a document of their project."""
    v = detect.dictionary_values(load(spark, d, "dictionary"))
    here = redact.present_values(load(spark, d, "documents").select("project_id", "text"), v, "project_id", "text", "value")
    return v.join(here, ["project_id", "value"], "left_semi").select("project_id", "kind", "value", "placeholder_prefix")


# ---- mapping ------------------------------------------------------------------------------------------------------------------------


@query("candidate_ids", f"SELECT DISTINCT kind, original, {_ID} AS candidate_id FROM entities WHERE original IS NOT NULL AND kind IS NOT NULL")
def candidate_ids(spark, d):
    """The public identifiers of private values."""
    e = load(spark, d, "entities").filter("original is not null and kind is not null")
    return e.select("kind", "original", candidate_id(F.col("kind"), F.col("original")).alias("candidate_id")).distinct()


@query("decisions_normalized", f"WITH {_DECISIONS} SELECT project_id, candidate_id, x.a AS action, x.s AS strategy FROM d")
def decisions_normalized(spark, d):
    """Review decisions with known actions and strategies only."""
    return mapping.normalize_decisions(load(spark, d, "decisions"))


@query("decision_effects", f"WITH {_DECIDED} SELECT project_id, kind, kept, count(*) AS n FROM dec GROUP BY ALL")
def decision_effects(spark, d):
    """How many entities of each kind are kept or redacted."""
    return mapping.decided(_entities(spark, d), load(spark, d, "decisions")).groupBy("project_id", "kind", "kept").agg(F.count("*").alias("n"))


@query("unmatched_decisions", f"WITH {_DECIDED} SELECT project_id, candidate_id FROM d WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.project_id = d.project_id AND ed.candidate_id = d.candidate_id)")
def unmatched_decisions(spark, d):
    """Decisions that belong to no entity."""
    return audit.unmatched_decisions(_entities(spark, d), load(spark, d, "decisions"))


@query("mapping_items", f"WITH {_MAPPING} SELECT * FROM m")
def mapping_items(spark, d):
    """The private mapping of every project."""
    return _mapped(spark, d)


@query("mapping_stats", "SELECT project_id, kind, count(*) AS n FROM (SELECT DISTINCT project_id, candidate_id, kind FROM mapping_items) GROUP BY ALL")
def mapping_stats(spark, d):
    """Public counts of the delivered mappings."""
    return mapping.mapping_stats(load(spark, d, "mapping_items"))


@query("placeholder_prefixes", "SELECT DISTINCT project_id, placeholder, CASE WHEN regexp_full_match(regexp_replace(placeholder, '（[^）]*）$', ''), '.*?[A-Z]+') THEN regexp_extract(regexp_replace(placeholder, '（[^）]*）$', ''), '^(.*?)([A-Z]+)$', 1) ELSE regexp_replace(placeholder, '（[^）]*）$', '') END AS prefix FROM mapping_items WHERE placeholder IS NOT NULL")
def placeholder_prefixes(spark, d):
    """Placeholders without their letters."""
    return mapping.placeholder_prefix(load(spark, d, "mapping_items").filter("placeholder is not null")).select("project_id", "placeholder", "prefix").distinct()


@query("placeholder_letters", f"SELECT n, {sql_letters('n')} AS letters FROM (SELECT DISTINCT ord + 1 AS n FROM entities WHERE ord >= 0)")
def placeholder_letters(spark, d):
    """Sequence numbers as letters."""
    return load(spark, d, "entities").filter("ord >= 0").select((F.col("ord") + 1).alias("n")).distinct().select("n", letters(F.col("n")).alias("letters"))


@query("mapping_merge")
def mapping_merge(spark, d):
    """The delivered mappings with the entities of the documents appended under fresh placeholders."""
    new = detect.ordered(detect.detect(load(spark, d, "documents").filter("project_id is not null").select("project_id", "doc_id", "text"), ["project_id"], "doc_id", "text"), ["project_id"])
    return mapping.merge_mapping(load(spark, d, "mapping_items"), new, load(spark, d, "decisions"))


# ---- redaction ----------------------------------------------------------------------------------------------------------------------


#: Values of a project, longest first; those of equal length in the order of the mapping. Claimed places are marked in a mask of the text:
#: a value hits left to right, behind each hit, and replaces what no longer value has claimed.
_PAIRS = "pr AS (SELECT project_id, list(struct_pack(o := original, r := coalesce(nullif(replacement, ''), placeholder)) ORDER BY length(original) DESC, ord, candidate_id) AS ps FROM (SELECT DISTINCT ON (project_id, original) * FROM (SELECT DISTINCT ON (project_id, candidate_id) * FROM mapping_items ORDER BY project_id, candidate_id) ORDER BY project_id, original, ord) WHERE original <> '' GROUP BY 1)"


def sql_redacted(text: str, pairs: str) -> str:
    """Replacement by cutting: pieces of text that nothing has claimed are split at each value in turn, longest first. A piece is
    (t, done); splitting and gluing lists is all that happens, so it shares nothing with a search by an automaton."""
    cut = "list_filter(flatten(list_transform(range(1, len(string_split(p.t, v.o)) + 1), lambda i: [struct_pack(t := string_split(p.t, v.o)[i], done := false), struct_pack(t := CASE WHEN i < len(string_split(p.t, v.o)) THEN v.r ELSE '' END, done := true)])), lambda q: q.t <> '')"
    return f"(SELECT string_agg(q.t, '') FROM (SELECT unnest(list_reduce(list_concat([[struct_pack(t := {text}, done := false)]], list_transform(list_filter({pairs}, lambda v: contains({text}, v.o)), lambda v: [struct_pack(t := v.o || chr(1) || v.r, done := true)])), lambda acc, w: flatten(list_transform(acc, lambda p: CASE WHEN p.done THEN [p] ELSE {cut.replace('v.o', 'string_split(w[1].t, chr(1))[1]').replace('v.r', 'string_split(w[1].t, chr(1))[2]')} END)))) AS q))"


@query("redact_documents", f"WITH {_PAIRS} SELECT d.project_id, doc_id, CASE WHEN text = '' OR ps IS NULL THEN text ELSE {sql_redacted('text', 'ps')} END AS text FROM (SELECT DISTINCT project_id, doc_id, text FROM documents WHERE project_id IS NOT NULL) d LEFT JOIN pr ON pr.project_id = d.project_id")
def redact_documents(spark, d):
    """Documents with the values of their project's mapping replaced."""
    t = load(spark, d, "documents").filter("project_id is not null").select("project_id", "doc_id", "text")
    return redact.redact(t, load(spark, d, "mapping_items").dropDuplicates(["project_id", "candidate_id"]), "project_id", "doc_id", "text")


@query("restore_roundtrip", "SELECT doc_id, md5(text) AS restored FROM documents WHERE project_id IS NOT NULL AND text IS NOT NULL")
def restore_roundtrip(spark, d):
    """The digest of each document as it comes back after redaction under placeholders that no text holds; the SQL has that of the original.

    The placeholders get a mark that stands in no document, as the inverse is only defined for texts without placeholders."""
    t = load(spark, d, "documents").filter("project_id is not null and text is not null").select("project_id", "doc_id", "text")
    i = load(spark, d, "mapping_items").dropDuplicates(["project_id", "candidate_id"]).withColumn("placeholder", F.concat(F.lit("⟦"), "candidate_id", F.lit("⟧"))).withColumn("replacement", F.col("placeholder"))
    back = redact.redact(redact.redact(t, i, "project_id", "doc_id", "text"), i, "project_id", "doc_id", "text", restore=True)
    return back.select("doc_id", F.md5("text").alias("restored"))


@query(
    "redact_cells",
    f"WITH {_PAIRS}, c AS (SELECT block_key, project_id, unnest(range(1, len(structure.cells) + 1)) AS pos, unnest(structure.cells) AS cell FROM (SELECT DISTINCT ON (block_key) * FROM redacted_text_blocks WHERE structure.cells IS NOT NULL)), "
    f"w AS (SELECT block_key, pos, cell.ref AS ref, cell.text AS text, ps FROM c LEFT JOIN pr ON pr.project_id = c.project_id), r AS (SELECT block_key, pos, ref, CASE WHEN text = '' OR ps IS NULL THEN text ELSE {sql_redacted('text', 'ps')} END AS text FROM w) "
    "SELECT block_key, string_agg(ref || '=' || coalesce(text, ''), '|' ORDER BY pos) AS cells FROM r GROUP BY 1",
)
def redact_cells(spark, d):
    """The cells of table rows with their texts replaced."""
    x = redact.redact_cells(load(spark, d, "redacted_text_blocks"), load(spark, d, "mapping_items").dropDuplicates(["project_id", "candidate_id"]), "project_id", "block_key")
    return x.select("block_key", F.array_join(F.transform("cells", lambda c: F.concat(c["ref"], F.lit("="), F.coalesce(c["text"], F.lit("")))), "|").alias("cells"))


# ---- audits -------------------------------------------------------------------------------------------------------------------------

_NEEDLES = f"{_DECIDED}, kv AS (SELECT DISTINCT project_id, original FROM dec WHERE kept), {_VALUES}, al AS (SELECT project_id, original AS needle, 'mapping' AS source FROM mapping_items WHERE original <> '' AND NOT (kind = 'technical_metric' AND strategy = 'keep') UNION ALL SELECT project_id, value, 'dictionary' FROM v), nd AS (SELECT al.project_id, al.needle, max(al.source) AS source FROM al LEFT JOIN kv ON kv.project_id = al.project_id AND kv.original = al.needle WHERE kv.original IS NULL GROUP BY 1, 2)"


def _needles(spark, d):
    kept = audit.kept_values(_entities(spark, d), load(spark, d, "decisions"))
    return audit.residual_needles(load(spark, d, "mapping_items"), kept, detect.dictionary_values(load(spark, d, "dictionary")))


@query("kept_values", f"WITH {_DECIDED} SELECT DISTINCT project_id, original FROM dec WHERE kept")
def kept_values(spark, d):
    """Values that stay by decision or by default."""
    return audit.kept_values(_entities(spark, d), load(spark, d, "decisions"))


@query("residual_needles", f"WITH {_NEEDLES} SELECT project_id, needle, source FROM nd")
def residual_needles(spark, d):
    """What must not be left in the redacted texts of a project."""
    return _needles(spark, d)


@query(
    "residual_scan",
    f"WITH {_NEEDLES}, h AS (SELECT nd.*, EXISTS (SELECT 1 FROM redacted_text_blocks b WHERE b.project_id = nd.project_id AND contains(b.text, nd.needle)) AS hit FROM nd), c AS (SELECT project_id, count(*) AS checked, count(*) FILTER (WHERE hit) AS hits FROM h GROUP BY 1) SELECT p.project_id, coalesce(checked, 0) AS checked, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) > 0 THEN 'residual_found' ELSE 'clear' END AS status FROM (SELECT DISTINCT project_id FROM redacted_text_blocks) p LEFT JOIN c USING (project_id)",
)
def residual_scan(spark, d):
    """How many values are left in the redacted texts of each project."""
    return audit.scan_residuals(load(spark, d, "redacted_text_blocks").select("project_id", "text"), _needles(spark, d))


@query("impact_items", f"WITH {_IMPACTS} SELECT * FROM impacts")
def impact_items(spark, d):
    """What redacting or keeping each entity costs an assessment."""
    return _impacts(spark, d)


def _sql_domain(x: str) -> str:
    return f"coalesce(max_by(impact_level, {_SCORE}) FILTER (WHERE action = 'redact' AND impact_domain = '{x}'), 'none') AS {x}_impact"


def _sql_fields(cond: str, name: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (WHERE {cond})), ','), '') AS {name}"


@query(
    "impact_summary",
    f"WITH {_IMPACTS} SELECT project_id, CASE WHEN bool_or(action = 'redact' AND impact_level = 'high') THEN 'blocked_requires_confirmation' WHEN coalesce(max({_SCORE}) FILTER (WHERE action = 'redact'), 0) >= 2 OR bool_or(action = 'keep' AND impact_domain = 'privacy') THEN 'warning' ELSE 'pass' END AS overall_level, "
    + ", ".join(_sql_domain(x) for x in ("trl", "benefit", "evidence", "transfer_readiness"))
    + ", "
    + ", ".join([_sql_fields("action = 'redact' AND strategy = 'mask'", "strongly_redacted_fields"), _sql_fields("action = 'redact' AND impact_level IN ('medium', 'high')", "redacted_assessment_fields"), _sql_fields("action = 'keep'", "preserved_assessment_factors"), _sql_fields("action = 'keep' AND impact_domain = 'privacy'", "kept_sensitive_fields")])
    + " FROM impacts GROUP BY 1",
)
def impact_summary(spark, d):
    """The assessment gate of each project."""
    return audit.impact_summary(_impacts(spark, d))


_FLAGS = f"fl AS (SELECT project_id, bool_or(regexp_matches(coalesce(text, ''), {lit(TECHNICAL_SIGNAL)})) AS trl FROM redacted_text_blocks GROUP BY 1), mi AS (SELECT project_id, bool_or(kind = 'amount' AND coalesce(preservation_value, '') <> '') AS benefit, count(*) FILTER (WHERE kind = 'amount') AS amounts FROM mapping_items GROUP BY 1)"


@query("analysis_flags", f"WITH {_FLAGS} SELECT fl.project_id, trl AS trl_factors_preserved, coalesce(benefit, false) AS benefit_factors_preserved, mi.project_id IS NOT NULL AS stable_placeholders_used FROM fl LEFT JOIN mi USING (project_id)")
def analysis_flags(spark, d):
    """What an analysis can still use."""
    return audit.analysis_flags(load(spark, d, "redacted_text_blocks").select("project_id", "text"), load(spark, d, "mapping_items"))


@query("structured_facts", "WITH i AS (SELECT DISTINCT * FROM mapping_items) SELECT project_id, coalesce(string_agg(placeholder || '=' || coalesce(preservation_value, ''), ';' ORDER BY ord, candidate_id) FILTER (WHERE kind = 'amount'), '') AS amount_ranges, count(*) FILTER (WHERE kind = 'patent_id') AS patent_count FROM i GROUP BY 1")
def structured_facts(spark, d):
    """Ranges and counts that stay computable."""
    return audit.structured_facts(load(spark, d, "mapping_items"))


_FILES = "fi AS (SELECT DISTINCT project_id, file_ord, file_name, file_type, file_hash, parser_status, warnings, path, received_at FROM files)"


@query(
    "review_warnings",
    f"WITH {_FLAGS}, {_FILES}, fs AS (SELECT project_id, string_agg(file_name, '、' ORDER BY file_ord) FILTER (WHERE coalesce(parser_status, '') <> 'ok') AS failed, string_agg(file_name, '、' ORDER BY file_ord) FILTER (WHERE len(list_filter(warnings, lambda w: contains(w, 'ocr_low_confidence'))) > 0) AS low, count(*) FILTER (WHERE coalesce(parser_status, '') <> 'ok') AS nf, count(*) FILTER (WHERE len(list_filter(warnings, lambda w: contains(w, 'ocr_low_confidence'))) > 0) AS nl FROM fi GROUP BY 1), w AS (SELECT fl.project_id, list_filter([CASE WHEN NOT trl THEN 'no_technical_signal' END, CASE WHEN coalesce(amounts, 0) = 0 THEN 'no_amounts' WHEN NOT coalesce(benefit, false) THEN 'amounts_without_range' END, CASE WHEN nf > 0 THEN 'files_failed:' || coalesce(failed, '') END, CASE WHEN nl > 0 THEN 'ocr_low_confidence:' || coalesce(low, '') END, 'not_for_direct_release'], lambda x: x IS NOT NULL) AS ws FROM fl LEFT JOIN mi USING (project_id) LEFT JOIN fs USING (project_id)) SELECT project_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS warning FROM w",
)
def review_warnings(spark, d):
    """The warnings of each project's package, in order."""
    return audit.review_warnings(load(spark, d, "redacted_text_blocks").select("project_id", "text"), load(spark, d, "mapping_items"), load(spark, d, "files"))


# ---- review and packages ------------------------------------------------------------------------------------------------------------


@query("review_candidates", f"WITH {_IMPACTS}, a AS (SELECT DISTINCT project_id, candidate_id, kind, placeholder, replacement, strategy, preservation_value, {sql_profile('kind', 1, 'low')} AS impact_level FROM m) SELECT * FROM a UNION ALL SELECT project_id, candidate_id, kind, '', '', coalesce(strategy, 'keep'), NULL, impact_level FROM impacts i WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.project_id = i.project_id AND a.candidate_id = i.candidate_id)")
def review_candidates(spark, d):
    """Mapped and kept fields as candidates of a review."""
    return review.review_candidates(_mapped(spark, d), _impacts(spark, d))


@query(
    "workspace_candidates",
    f"WITH w AS (SELECT DISTINCT project_id, kind, original, strategy, coalesce(placeholder_prefix, '') AS placeholder_prefix FROM entities WHERE original <> '' AND kind IS NOT NULL) SELECT project_id, {_ID} AS candidate_id, kind, strategy AS default_strategy, CASE WHEN strategy = 'keep' THEN 'keep' ELSE 'redact' END AS recommended_action, placeholder_prefix, CASE WHEN kind = 'amount' THEN 'prefer_range' WHEN kind IN ('technical_metric', 'validation_evidence') THEN 'prefer_keep' WHEN kind IN ('project_name', 'organization', 'contract_id', 'phone', 'email') THEN 'identity' WHEN kind = 'patent_id' THEN 'keep_kind_and_count' WHEN strategy = 'range' THEN 'prefer_range' ELSE 'review' END AS review_hint, {sql_profile('kind', 0, 'other')} AS impact_domain, {sql_profile('kind', 1, 'low')} AS impact_level FROM w",
)
def workspace_candidates(spark, d):
    """Entities as candidates of a review workspace."""
    return review.workspace_candidates(load(spark, d, "entities"))


_BLOCKS = "b AS (SELECT DISTINCT project_id, file_ord, block_key, text FROM redacted_text_blocks)"


@query("block_numbers", f"WITH {_BLOCKS}, k AS (SELECT DISTINCT project_id, file_ord, block_key FROM b) SELECT block_key, printf('blk_%04d', row_number() OVER (PARTITION BY project_id ORDER BY file_ord, block_key)) AS block_id FROM k")
def block_numbers(spark, d):
    """Blocks numbered within their project."""
    b = load(spark, d, "redacted_text_blocks").select("project_id", "file_ord", F.col("block_key").alias("block_ord")).distinct()
    return review.number_blocks(b).select(F.col("block_ord").alias("block_key"), "block_id")


@query("sandbox_files", f"WITH {_FILES} SELECT project_id, file_name, file_type, file_hash, parser_status, coalesce(array_to_string(warnings, ';'), '') AS warnings FROM fi")
def sandbox_files(spark, d):
    """The public file records of a sandbox import."""
    return review.sandbox_files(load(spark, d, "files"))


@query(
    "batch_manifest",
    f"WITH {_FILES}, f AS (SELECT project_id, count(*) AS file_count, count(*) FILTER (WHERE parser_status = 'ok') AS ok_count FROM fi GROUP BY 1), b AS (SELECT project_id, count(DISTINCT block_key) AS block_count FROM redacted_text_blocks GROUP BY 1), i AS (SELECT project_id, count(DISTINCT candidate_id) AS field_count FROM mapping_items GROUP BY 1) SELECT project_id, file_count, ok_count, coalesce(block_count, 0) AS block_count, coalesce(field_count, 0) AS field_count FROM f LEFT JOIN b USING (project_id) LEFT JOIN i USING (project_id)",
)
def batch_manifest(spark, d):
    """The counts of every project of the batch."""
    return review.batch_manifest(load(spark, d, "files"), load(spark, d, "redacted_text_blocks"), load(spark, d, "mapping_items"))


@query("restore_preview", f"WITH {_BLOCKS} SELECT project_id, substr(string_agg(text, chr(10) ORDER BY file_ord, block_key), 1, 600) AS preview FROM b WHERE text IS NOT NULL GROUP BY 1")
def restore_preview(spark, d):
    """The beginning of each project's redacted text."""
    b = load(spark, d, "redacted_text_blocks").select("project_id", "file_ord", F.col("block_key").alias("block_ord"), "text").distinct()
    return review.restore_preview(b)


# ---- planning, release, governance --------------------------------------------------------------------------------------------------

_SUFFIX = "lower(regexp_extract(coalesce(path, ''), '[^/\\\\](\\.[^./\\\\]+)$', 1))"
_CLASS = f"CASE WHEN {_SUFFIX} IN ({', '.join(map(lit, planning.PROCESSABLE))}) THEN 'processable' WHEN {_SUFFIX} IN ({', '.join(map(lit, planning.CONVERTIBLE))}) THEN 'convertible' WHEN {_SUFFIX} IN ({', '.join(map(lit, planning.SKIPPED))}) OR {_SUFFIX} = '' THEN 'skipped' ELSE 'unsupported' END"
_PLAN = f"pl AS (SELECT path, CASE WHEN {_SUFFIX} = '' THEN '(none)' ELSE {_SUFFIX} END AS extension, {_CLASS} AS input_class, CASE {_CLASS} WHEN 'convertible' THEN 'office_conversion_required' WHEN 'skipped' THEN 'not_document_input' WHEN 'unsupported' THEN 'unsupported_format' ELSE '' END AS reason, CASE WHEN {_SUFFIX} = '.xls' THEN '.xlsx' WHEN {_SUFFIX} IN ('.doc', '.wps') THEN '.docx' ELSE '' END AS target_extension FROM (SELECT DISTINCT path FROM files))"


@query("input_plan", f"WITH {_PLAN} SELECT * FROM pl")
def input_plan(spark, d):
    """What each delivered path is good for."""
    return planning.input_plan(load(spark, d, "files"), "path")


@query("input_plan_status", f"WITH {_PLAN}, c AS (SELECT count(*) FILTER (WHERE input_class = 'processable') AS processable, count(*) FILTER (WHERE input_class = 'convertible') AS convertible, count(*) FILTER (WHERE input_class = 'unsupported') AS unsupported, count(*) FILTER (WHERE input_class = 'skipped') AS skipped FROM pl) SELECT *, CASE WHEN processable = 0 AND convertible = 0 THEN 'blocked_no_inputs' WHEN convertible + unsupported + skipped > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS status FROM c")
def input_plan_status(spark, d):
    """The plan as counts and a status."""
    return planning.plan_status(planning.input_plan(load(spark, d, "files"), "path"))


@query("inputs_by_extension", f"WITH {_PLAN} SELECT extension, count(*) AS n FROM pl WHERE input_class = 'processable' GROUP BY 1")
def inputs_by_extension(spark, d):
    """Processable paths by suffix."""
    return planning.input_plan(load(spark, d, "files"), "path").filter("input_class = 'processable'").groupBy("extension").agg(F.count("*").alias("n"))


@query("conversion_report", f"WITH {_PLAN} SELECT path, target_extension, 'office_converter_not_found' AS status FROM pl WHERE input_class = 'convertible'")
def conversion_report(spark, d):
    """Legacy office files and why they are not converted here."""
    return planning.conversion_report(planning.input_plan(load(spark, d, "files"), "path"))


@query("ocr_page_merge", "SELECT file_key, coalesce(string_agg(text, chr(10) ORDER BY block_key) FILTER (WHERE text <> ''), '') AS text, round(coalesce(avg(conf) FILTER (WHERE conf > 0), 0.0), 6) AS confidence, CASE WHEN coalesce(string_agg(text, '') , '') = '' THEN 'empty' ELSE 'ok' END AS status FROM (SELECT DISTINCT project_id || '#' || file_ord AS file_key, block_key, text, structure.confidence AS conf FROM redacted_text_blocks WHERE structure.confidence IS NOT NULL) GROUP BY 1")
def ocr_page_merge(spark, d):
    """Recognised blocks merged to one text for each file."""
    b = load(spark, d, "redacted_text_blocks").filter("structure.confidence is not null")
    p = b.select(F.concat("project_id", F.lit("#"), F.col("file_ord").cast("string")).alias("file_key"), F.col("block_key").alias("page"), "text", F.col("structure.confidence").alias("confidence")).distinct()
    return planning.merge_pages(p, "file_key").withColumn("confidence", F.round("confidence", 6))


@query(
    "ocr_quality",
    f"WITH {_FILES}, {_BLOCKS}, t AS (SELECT project_id, file_ord, sum(length({sql_strip('text')})) AS n FROM b WHERE text IS NOT NULL GROUP BY 1, 2) SELECT fi.project_id, fi.file_ord, CASE WHEN coalesce(parser_status, '') = 'ocr_required' OR coalesce(list_contains(warnings, 'ocr_required'), false) THEN 'blocked' WHEN coalesce(n, 0) < 20 AND lower(coalesce(file_type, '')) = 'pdf' THEN 'warning' ELSE 'ok' END AS quality FROM fi LEFT JOIN t USING (project_id, file_ord)",
)
def ocr_quality(spark, d):
    """Whether each file's text was read well enough."""
    from veilspark.functions.text import strip

    f = load(spark, d, "files").select("project_id", "file_ord", "file_type", "parser_status", "warnings").distinct()
    t = load(spark, d, "redacted_text_blocks").select("project_id", "file_ord", "block_key", "text").distinct().filter("text is not null").groupBy("project_id", "file_ord").agg(F.sum(F.length(strip(F.col("text")))).alias("n"))
    x = f.join(t, ["project_id", "file_ord"], "left")
    return x.select("project_id", "file_ord", planning.quality_gate(F.col("parser_status"), F.col("file_type"), F.col("warnings"), F.col("n")).alias("quality"))


@query("ocr_warnings", "SELECT DISTINCT project_id, file_ord, CASE WHEN ocr_status = 'ok' THEN 'ocr_applied' || CASE WHEN ocr_confidence < 0.5 THEN ';ocr_low_confidence:' || printf('%.2f', ocr_confidence) ELSE '' END ELSE '' END AS warnings FROM files WHERE ocr_status IS NOT NULL")
def ocr_warnings(spark, d):
    """The warnings that recognition adds to a file."""
    f = load(spark, d, "files").filter("ocr_status is not null")
    return f.select("project_id", "file_ord", F.array_join(planning.ocr_warnings(F.col("ocr_status"), F.col("ocr_confidence")), ";").alias("warnings")).distinct()


#: The table of files has no channels; a rule over its columns stands in for an inspection, so that every branch of the gate is met.
_CHANNELS = "CASE file_ord % 7 WHEN 0 THEN 'unverified' WHEN 1 THEN 'found' WHEN 2 THEN NULL ELSE 'clear' END"
_KINDS = "CASE WHEN file_ord % 7 = 1 THEN CASE file_ord % 5 WHEN 0 THEN ['header'] WHEN 1 THEN ['comment', 'header'] WHEN 2 THEN ['hidden_sheet', 'binary_media'] WHEN 3 THEN ['unknown_part'] ELSE ['external_relationship', 'very_hidden_sheet', 'embedded_object'] END END"
_REASON = (
    "CASE WHEN lower(coalesce(file_type, '')) = 'pdf' THEN 'pdf_external_release_disabled' WHEN coalesce(parser_status, '') <> 'ok' THEN 'source_parse_not_ok' WHEN coalesce(c, '') NOT IN ('clear', 'found') THEN 'hidden_channels_unverified' "
    "WHEN list_contains(k, 'external_relationship') THEN 'external_relationship' "
    "WHEN len(list_filter(k, lambda x: x IN ('binary_media', 'embedded_object', 'hidden_sheet', 'unknown_part', 'very_hidden_sheet') OR (x = 'comment' AND lower(file_type) <> 'docx'))) > 0 THEN list_min(list_filter(k, lambda x: x IN ('binary_media', 'embedded_object', 'hidden_sheet', 'unknown_part', 'very_hidden_sheet') OR (x = 'comment' AND lower(file_type) <> 'docx'))) "
    "WHEN lower(coalesce(file_type, '')) IN ('docx', 'xlsx') THEN 'rewrite_or_validation_failed' WHEN lower(coalesce(file_type, '')) NOT IN ('txt', 'md') THEN 'unsupported' END"
)
_GATED = f"(SELECT project_id, file_ord, {_REASON} AS reason FROM (SELECT DISTINCT project_id, file_ord, file_type, parser_status, {_CHANNELS} AS c, {_KINDS} AS k FROM files))"


def _gated(spark, d):
    f = load(spark, d, "files").select("project_id", "file_ord", "file_type", "parser_status").distinct()
    o, arrays = F.col("file_ord"), lambda *x: F.array(*map(F.lit, x))
    status = F.when(o % 7 == 0, "unverified").when(o % 7 == 1, "found").when(o % 7 == 2, None).otherwise("clear")
    kinds = F.when(o % 5 == 0, arrays("header")).when(o % 5 == 1, arrays("comment", "header")).when(o % 5 == 2, arrays("hidden_sheet", "binary_media")).when(o % 5 == 3, arrays("unknown_part")).otherwise(arrays("external_relationship", "very_hidden_sheet", "embedded_object"))
    return f.select("project_id", "file_ord", release.file_gate(F.col("file_type"), F.col("parser_status"), status, F.when(o % 7 == 1, kinds)).alias("reason"))


@query("release_gate", f"SELECT * FROM {_GATED}")
def release_gate(spark, d):
    """Why each file may not leave, or null."""
    return _gated(spark, d)


@query("release_manifest", f"SELECT project_id, count(*) FILTER (WHERE reason IS NULL) AS exported_count, count(*) FILTER (WHERE reason IS NOT NULL) AS blocked_count FROM {_GATED} GROUP BY 1")
def release_manifest(spark, d):
    """Exported and blocked files by project."""
    return release.release_manifest(_gated(spark, d))


@query("secret_scan", f"SELECT doc_id, line FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS l FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(l, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(l, '(api[_-]?key|secret|smtp[_-]?password)\\s*[:=]\\s*[''\"]?[A-Za-z0-9_\\-]{{12,}}', 'i')")
def secret_scan(spark, d):
    """Lines of documents that look like keys or passwords."""
    return governance.secret_scan(load(spark, d, "documents"), "doc_id", "text")


@query("blocked_names", "SELECT DISTINCT path FROM files WHERE lower(path) LIKE '.release%' OR lower(path) LIKE '%/.release%' OR lower(path) LIKE '%\\.release%' OR lower(path) LIKE '%local_mapping.private%' OR lower(path) LIKE '%trial@_usage@_%.json' ESCAPE '@' OR lower(path) LIKE '%registration@_request.json' ESCAPE '@' OR lower(path) LIKE '%registration@_mailto.txt' ESCAPE '@' OR lower(path) = 'license.json' OR lower(path) LIKE '%/license.json' OR lower(path) LIKE '%privatekey%' OR lower(path) LIKE '%private-key%' OR lower(path) LIKE '%private@_key%' ESCAPE '@' OR lower(path) LIKE '%secret%' OR lower(path) LIKE '%.env' OR lower(path) LIKE '%.pem' OR lower(path) LIKE '%.key'")
def blocked_names(spark, d):
    """Delivered paths that must not be published."""
    return governance.blocked_names(load(spark, d, "files"), "path")


@query(
    "rules_update_check",
    "WITH g AS (SELECT kind, max(strategy) AS action FROM entities WHERE kind IS NOT NULL AND strategy IS NOT NULL GROUP BY 1) SELECT CASE WHEN EXISTS (SELECT 1 FROM g WHERE kind = 'technical_metric' AND action <> 'keep') THEN 'blocked' WHEN EXISTS (SELECT 1 FROM g WHERE kind = 'amount' AND action NOT IN ('range', 'keep')) THEN 'blocked' ELSE 'valid' END AS status, CASE WHEN EXISTS (SELECT 1 FROM g WHERE kind = 'technical_metric' AND action <> 'keep') THEN 'technical_metric' WHEN EXISTS (SELECT 1 FROM g WHERE kind = 'amount' AND action NOT IN ('range', 'keep')) THEN 'amount' ELSE '' END AS message",
)
def rules_update_check(spark, d):
    """Whether the default actions found in the entities would pass as a rules update."""
    g = load(spark, d, "entities").filter("kind is not null and strategy is not null").groupBy("kind").agg(F.max("strategy").alias("a"))
    u = g.agg(F.collect_list(F.struct(F.col("kind").alias("name"), F.col("a").alias("default_action"))).alias("field_groups"))
    u = u.select(F.lit(governance.RULES_SCHEMA).alias("schema_version"), F.lit("1").alias("version"), F.array(*[F.lit(x) for x in governance.GUARDRAILS]).alias("guardrails"), "field_groups")
    return governance.rules_update(u).select("status", "message")
