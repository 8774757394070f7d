"""Log, source and path mining over documents, pages, conversations and lines built from events."""

from __future__ import annotations

from ..operators import relational, steps, texts
from .registry import query

# --- log texts: a few lines per event ---------------------------------------------------------------

_LINE = ("case {k} % 6 when 0 then concat('Accuracy: ', {v}) when 1 then concat('val rmse = ', {v})"
         " when 2 then concat('Final Validation Performance: ', {v}) when 3 then concat('start score from ', {v})"
         " when 4 then concat('Registered external pipeline: dir/p_', event_id, '.py') else 'nothing here' end")
_V = "cast(cast(round(value * 100) as bigint) as {t})"


def _text(string: str, newline: str) -> str:
    rows = [_LINE.format(k=k, v=_V.format(t=string)) for k in ("event_id", "(event_id + user_id)", "(event_id * 5 + 1)")]
    return f"concat({f', {newline}, '.join(['event_type', *rows, 'props'])})"


LOGS = f"logs AS (SELECT event_id, user_id, {_text('varchar', 'chr(10)')} AS text FROM events)"


def logs(t):
    return t.events.selectExpr("event_id", "user_id", f"{_text('string', 'chr(10)')} as text")


_SPLIT = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no"
_NUM = "([0-9]*[.]?[0-9]+)"
_MET = texts.METRIC_WORDS


def _metric_sql(base: str, keys: str) -> str:
    hit = {w: f"nullif(regexp_extract(lower(line), '{w}\\s*[:=]\\s*{_NUM}', 1), '')" for w in _MET}
    name = " ".join(f"WHEN {x} IS NOT NULL THEN '{w}'" for w, x in hit.items())
    value = f"coalesce({', '.join(hit.values())}, nullif(regexp_extract(line, '{_NUM}', 1), ''))"
    has = " OR ".join(f"contains(lower(line), '{w}')" for w in _MET)
    return f"""l AS (SELECT {keys}, {_SPLIT} FROM {base}),
m AS (SELECT {keys}, line_no, line, CASE {name} ELSE 'generic' END AS metric, CAST({value} AS DOUBLE) AS value FROM l WHERE {has})
SELECT * FROM m WHERE value IS NOT NULL"""


query("extract_metrics", "event_id:i line_no:i metric value:f line", f"WITH {LOGS}, {_metric_sql('logs', 'event_id')}")(
    lambda t: texts.extract_metrics(logs(t), "text", ["event_id"]))

query("extract_metrics_documents", "doc_id:i line_no:i metric value:f", f"""
WITH b AS (SELECT doc_id, concat(text, chr(10), 'Score = ', n_chars) AS text FROM documents), {_metric_sql('b', 'doc_id')}""")(
    lambda t: texts.extract_metrics(
        t.documents.selectExpr("doc_id", "concat(text, '\\n', 'Score = ', n_chars) as text"), "text", ["doc_id"]))

query("parse_registrations", "event_id:i line_no:i file", f"""
WITH {LOGS}, l AS (SELECT event_id, {_SPLIT} FROM logs)
SELECT event_id, line_no, trim(substring(line, instr(line, ':') + 1)) AS file FROM l WHERE contains(line, 'Registered external pipeline:')""")(
    lambda t: texts.parse_registrations(logs(t), "text", ["event_id"]))

query("log_tail", "user_id:i file tail", f"""
WITH {LOGS}, n AS (SELECT *, concat('run_', lpad(CAST(event_id AS VARCHAR), 12, '0'), '.log') AS file FROM logs),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY file DESC) AS rn FROM n)
SELECT user_id, file, array_to_string(list_slice(string_split(text, chr(10)), greatest(1, len(string_split(text, chr(10))) - 2), len(string_split(text, chr(10)))), chr(10)) AS tail
FROM r WHERE rn = 1""")(
    lambda t: relational.log_tail(
        logs(t).selectExpr("user_id", "concat('run_', lpad(cast(event_id as string), 12, '0'), '.log') as file", "text"),
        "user_id", "file", "text", 3))

# --- source texts -----------------------------------------------------------------------------------------

query("text_quality",
      "doc_id:i lines_of_code:i has_comments has_docstring has_imports has_pipeline has_preprocessor"
      " has_feature_engineering has_model has_random_state comment_lines:i comment_ratio:f", """
WITH d AS (SELECT doc_id, concat('# ', source, chr(10), text, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'import model', chr(10), '  # Pipeline') ELSE '' END) AS t FROM documents),
q AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM d)
SELECT doc_id, len(ls) AS lines_of_code, contains(t, '#') OR contains(t, '\"\"\"') OR contains(t, '''''''') AS has_comments,
  contains(t, '\"\"\"') OR contains(t, '''''''') AS has_docstring, contains(t, 'import') OR contains(t, 'from') AS has_imports,
  contains(t, 'Pipeline') AS has_pipeline, contains(lower(t), 'preprocessor') AS has_preprocessor, contains(lower(t), 'feature') AS has_feature_engineering,
  contains(lower(t), 'model') OR contains(lower(t), 'classifier') AS has_model, contains(t, 'random_state') AS has_random_state,
  len(list_filter(ls, lambda x: starts_with(trim(x, ' ' || chr(9) || chr(13)), '#'))) AS comment_lines,
  len(list_filter(ls, lambda x: starts_with(trim(x, ' ' || chr(9) || chr(13)), '#'))) / len(ls) AS comment_ratio FROM q""")(
    lambda t: texts.text_quality(t.documents.selectExpr(
        "doc_id", "concat('# ', source, '\\n', text, if(doc_id % 3 = 0, '\\nimport model\\n  # Pipeline', '')) as t"), "t"))

_SRC = ("concat(text, CASE doc_id % 5 WHEN 0 THEN ' RandomForestClassifier(SVC)' WHEN 1 THEN ' GaussianNB # LogisticRegression'"
        " WHEN 2 THEN ' VotingClassifier(GradientBoosting) preprocessor model' ELSE ' model' END)")
_DET = ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{v}' END" for k, v in texts.MODEL_KEYWORDS.items())
query("keyword_detect", "doc_id:i detected_models:a complexity", f"""
WITH d AS (SELECT doc_id, {_SRC} AS t FROM documents), k AS (SELECT doc_id, list_filter([{_DET}], lambda x: x IS NOT NULL) AS detected_models FROM d)
SELECT *, CASE WHEN list_has_any(detected_models, {texts.COMPLEX_MODELS!r}) THEN 'complex' ELSE 'simple' END AS complexity FROM k""")(
    lambda t: texts.keyword_detect(t.documents.selectExpr("doc_id", f"{_SRC} as t"), "t"))

_REQ = ", ".join(f"CASE WHEN NOT contains(t, '{k}') THEN '{n}' END" for n, k in relational.REQUIRED_TOKENS.items())
_OPT = ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{n}' END" for n, k in relational.OPTIONAL_TOKENS.items())
query("semi_anti_columns", "doc_id:i missing_required:a found_optional:a", f"""
WITH d AS (SELECT doc_id, {_SRC} AS t FROM documents) SELECT doc_id, list_filter([{_REQ}], lambda x: x IS NOT NULL) AS missing_required,
  list_filter([{_OPT}], lambda x: x IS NOT NULL) AS found_optional FROM d""")(
    lambda t: relational.token_presence(t.documents.selectExpr("doc_id", f"{_SRC} as t"), "t",
                                        relational.REQUIRED_TOKENS, relational.OPTIONAL_TOKENS))


def _secret_sql(name: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{name.replace("'", "''")}' AS pattern, text, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS ps
  FROM documents WHERE regexp_matches(text, '{p}')"""


query("secret_scan", "doc_id:i pattern match context position:i", f"""
WITH h AS ({' UNION ALL '.join(_secret_sql(n, p) for n, p in texts.SECRET_PATTERNS.items())}),
e AS (SELECT doc_id, pattern, text, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM h),
s AS (SELECT doc_id, pattern, text, ms[i] AS m, 1 + CAST(list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) AS BIGINT)
  + CAST(coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS position FROM e),
c AS (SELECT doc_id, pattern, position, m, text, unnest(range(greatest(position - 80, 1), least(position + length(m) + 80, length(text) + 1))) AS px FROM s),
k AS (SELECT c.doc_id, c.pattern, c.position, c.m, c.px, CASE WHEN bool_or(o.doc_id IS NOT NULL) THEN '*' ELSE substring(any_value(c.text), c.px, 1) END AS ch
  FROM c LEFT JOIN s o ON o.doc_id = c.doc_id AND c.px >= o.position + 4 AND c.px < o.position + length(o.m) GROUP BY 1, 2, 3, 4, 5)
SELECT doc_id, pattern, position, concat(left(m, 4), repeat('*', length(m) - 4)) AS match,
  left(replace(string_agg(ch, '' ORDER BY px), chr(10), ' '), 200) AS context FROM k GROUP BY doc_id, pattern, position, m""")(
    lambda t: texts.secret_scan(t.documents, "text", ["doc_id"]))

_FENCE = ("case turn % 4 when 0 then concat('intro', {nl}, '```python', {nl}, text, {nl}, '```', {nl}, '```', {nl}, 'x = 1', {nl}, '```') "
          "when 1 then concat('see ', {nl}, 'import os', {nl}, text) when 2 then concat(text, {nl}, 'def main():', {nl}, '  pass') else text end")
query("extract_fenced", "conv_id:i turn:i n_blocks:i code", f"""
WITH c AS (SELECT conv_id, turn, {_FENCE.format(nl='chr(10)')} AS t FROM conversations),
b AS (SELECT *, regexp_extract_all(t, '(?is)```(?:python)?\\s*(.*?)\\s*```', 1) AS bs FROM c)
SELECT conv_id, turn, len(bs) AS n_blocks, CASE WHEN len(bs) > 0 THEN bs[1] ELSE
  coalesce(nullif(regexp_extract(t, '(?s)(?:import\\s+[\\w.,\\s]+|from\\s+[\\w.]+\\s+import\\s+).*', 0), ''), nullif(regexp_extract(t, '(?s)def main\\(\\):.*', 0), '')) END AS code FROM b""")(
    lambda t: texts.extract_fenced(t.conversations.selectExpr("conv_id", "turn", f"{_FENCE.format(nl=chr(39) + chr(92) + 'n' + chr(39))} as t"), "t"))

query("token_count", "doc_id:i estimated_tokens:i", """
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '')) AS estimated_tokens FROM documents""")(
    lambda t: texts.token_count(t.documents, "text"))

# --- names and paths ------------------------------------------------------------------------------------------

_FILE = ("concat(CASE p_size % 6 WHEN 0 THEN 'init_code_' WHEN 1 THEN 'train' WHEN 2 THEN 'refined_' WHEN 3 THEN 'ensemble' WHEN 4 THEN 'pipeline' ELSE 'x_' END, p_partkey, '.py')")
_ART = " ".join(f"WHEN starts_with(f, '{p}') THEN '{k}'" for p, k in texts.ARTIFACT_PREFIXES.items())
query("classify_artifact", "p_partkey:i artifact_type", f"""
WITH b AS (SELECT p_partkey, {_FILE} AS f FROM part) SELECT p_partkey, CASE {_ART} ELSE 'other' END AS artifact_type FROM b""")(
    lambda t: texts.classify_artifact(t.part.selectExpr("p_partkey", f"{_FILE} as f"), "f"))

_DSV = ("CASE p_size % 6 WHEN 0 THEN 'breast_cancer' WHEN 1 THEN concat('breast_cancer_', p_name) WHEN 2 THEN concat('wine_', p_partkey) WHEN 3 THEN 'iris'"
        " WHEN 4 THEN concat('reg_', p_size, '_z') ELSE 'plain' END")
_KN = texts.KNOWN_DATASETS
query("split_dataset_variant", "p_partkey:i dataset variant", f"""
WITH b AS (SELECT p_partkey, {_DSV} AS x FROM part)
SELECT p_partkey, CASE {' '.join(f"WHEN x = '{d}' OR starts_with(x, '{d}_') THEN '{d}'" for d in _KN)} WHEN contains(x, '_') THEN split_part(x, '_', 1) ELSE x END AS dataset,
  CASE {' '.join(f"WHEN x = '{d}' THEN '' WHEN starts_with(x, '{d}_') THEN substring(x, {len(d) + 2})" for d in _KN)}
  WHEN contains(x, '_') THEN substring(x, instr(x, '_') + 1) ELSE '' END AS variant FROM b""")(
    lambda t: texts.split_dataset_variant(t.part.selectExpr("p_partkey", f"{_DSV} as x"), "x"))

query("classify_source", "page_id:i method", """
WITH b AS (SELECT page_id, concat(url, CASE page_id % 5 WHEN 0 THEN '/adk/gemini' WHEN 1 THEN '/single_shot' WHEN 2 THEN '/gemini_x' ELSE '' END) AS p FROM pages)
SELECT page_id, CASE WHEN contains(p, 'adk') THEN 'ADK Agent' WHEN contains(p, 'single_shot') OR contains(p, 'gemini') THEN 'Single Shot' ELSE 'Unknown' END AS method FROM b""")(
    lambda t: texts.classify_source(t.pages.selectExpr(
        "page_id", "concat(url, case page_id % 5 when 0 then '/adk/gemini' when 1 then '/single_shot' when 2 then '/gemini_x' else '' end) as p"), "p"))

_PATH = ("CASE doc_id % 5 WHEN 0 THEN concat('run/results/', source, '/s.csv') WHEN 1 THEN concat('results/variants_n10/iris_', lang, '/s.csv')"
         " WHEN 2 THEN concat('old/', source, '/wine_', lang, '/s.csv') WHEN 3 THEN 'results/variants' ELSE concat('x/', source) END")
query("dataset_from_path", "doc_id:i dataset_variant", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN concat('iris_', lang) WHEN 2 THEN concat('wine_', lang)
  WHEN 3 THEN 'variants' ELSE 'unknown' END AS dataset_variant FROM documents""")(
    lambda t: texts.dataset_from_path(t.documents.selectExpr("doc_id", f"{_PATH} as path"), "path"))

_NAME = ("concat('gemini_', CASE doc_id % 8 WHEN 0 THEN 'california' WHEN 1 THEN 'diabetes' WHEN 2 THEN 'digits' WHEN 3 THEN 'iris'"
         " WHEN 4 THEN 'wine' WHEN 5 THEN 'breast_cancer' WHEN 6 THEN 'wine_digits' ELSE 'none' END, '_', lang)")
query("dataset_from_name", "doc_id:i dataset task_type", """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'california-housing-prices' WHEN 1 THEN 'diabetes' WHEN 2 THEN 'digits' WHEN 4 THEN 'wine'
  WHEN 5 THEN 'breast_cancer' WHEN 6 THEN 'digits' ELSE 'iris' END AS dataset,
  CASE WHEN doc_id % 8 < 2 THEN 'regression' ELSE 'classification' END AS task_type FROM documents""")(
    lambda t: texts.dataset_from_name(t.documents.selectExpr("doc_id", f"{_NAME} as f"), "f"))

_ENTRY = "struct({task} as task, cast(p_size as string) as run_id, p_name as source, {kind} as artifact_type)"
_KIND = "case p_partkey % 3 when 0 then 'train' when 1 then 'other' else 'ensemble' end"
query("explode_manifest", "task run_id source artifact_type", f"""
SELECT p_type AS task, CAST(p_size AS VARCHAR) AS run_id, p_name AS source, {_KIND} AS artifact_type FROM part
  WHERE p_partkey % 3 != 1 AND p_type IN ('ECONOMY', 'PROMO') UNION ALL
SELECT 'PROMO', CAST(p_size AS VARCHAR), p_name, 'pipeline' FROM part""")(
    lambda t: texts.explode_manifest(t.part.selectExpr(
        f"to_json(named_struct('total_entries', 2, 'entries', array({_ENTRY.format(task='p_type', kind=_KIND)},"
        f" {_ENTRY.format(task=repr('PROMO'), kind=repr('pipeline'))}))) as j"), "j", tasks=["ECONOMY", "PROMO"]))

# --- pipelines as step rows: one per order, its lines are the steps ------------------------------------------------

_NAMES = ["scaler", "pca", "clf", "imputer", "my_features", "std_scale", "custom", "model", "feature_selection"]
_CLS = ["StandardScaler", "PCA", "RandomForestClassifier", "SimpleImputer", "PolynomialFeatures", "MinMaxScaler", "PCA", "GridSearchCV",
        "VotingClassifier", "SelectKBest"]
# One comparable, unique position per line of an order.
_POS = "concat(" + ", '.', ".join(
    f"lpad(cast({c} as {{text}}), 12, '0')" for c in ("l_linenumber", "l_partkey", "l_suppkey", "cast(l_quantity as bigint)")) + ")"
STEPS = f"""steps AS (SELECT l_orderkey AS pipeline, ({_NAMES!r})[CAST(l_partkey % 9 AS BIGINT) + 1] AS name, ({_CLS!r})[CAST(l_suppkey % 10 AS BIGINT) + 1] AS class,
  {_POS.format(text='varchar')} AS pos FROM lineitem),
canon AS (SELECT *, CASE WHEN name IN ('scaler', 'imputer') THEN 'preprocessor' WHEN name = 'pca' THEN 'feature_engineering' WHEN name IN ('clf', 'model') THEN 'model'
  WHEN class = 'PCA' THEN 'feature_engineering' WHEN contains(name, 'feature') THEN 'feature_engineering' WHEN contains(name, 'scale') THEN 'preprocessor' ELSE name END AS c FROM steps),
named AS (SELECT *, CASE WHEN nth = 1 THEN c ELSE concat(c, '_', nth - 1) END AS step FROM (SELECT *, row_number() OVER (PARTITION BY pipeline, c ORDER BY pos) AS nth FROM canon) x)"""


def ordered_steps(t):
    def pick(names, key):
        return f"array({', '.join(repr(n) for n in names)})[cast({key} as int)]"

    return t.lineitem.selectExpr(
        "l_orderkey as pipeline", f"{pick(_NAMES, 'l_partkey % 9')} as name", f"{pick(_CLS, 'l_suppkey % 10')} as class",
        f"{_POS.format(text='string')} as pos")


query("canonical_steps", "pipeline:i pos name class step", f"WITH {STEPS} SELECT * FROM named")(
    lambda t: steps.canonical_steps(ordered_steps(t)))

_ENS = steps.ENSEMBLE_CLASSES
INSPECT = f"""insp AS (SELECT pipeline, bool_or(class = 'StandardScaler') AS has_scaler, bool_or(step = 'feature_engineering') AS has_feature_engineering,
  bool_or(step = 'feature_selection') AS has_feature_selection, bool_or(class IN ('GridSearchCV', 'RandomizedSearchCV')) AS has_tuning,
  bool_or(class IN ({', '.join(repr(c) for c in _ENS)})) AS has_ensembling, arg_max(class, pos) AS model_type, count(*) AS n_steps FROM named GROUP BY 1)"""
_INSPECT_SPEC = ("pipeline:i has_scaler has_feature_engineering has_feature_selection has_tuning has_ensembling model_type n_steps:i")
query("inspect_steps", _INSPECT_SPEC, f"WITH {STEPS}, {INSPECT} SELECT * FROM insp")(
    lambda t: steps.inspect_steps(steps.canonical_steps(ordered_steps(t))))

query("ablation_meaningful", "pipeline:i n_components:i meaningful", f"""
WITH {STEPS}, {INSPECT}, n AS (SELECT pipeline, CAST(has_scaler AS INTEGER) + CAST(has_feature_engineering AS INTEGER) + CAST(has_tuning AS INTEGER)
  + CAST(has_ensembling AS INTEGER) AS n_components FROM insp) SELECT *, n_components >= 2 AS meaningful FROM n""")(
    lambda t: steps.ablation_meaningful(steps.inspect_steps(steps.canonical_steps(ordered_steps(t)))))

_GONE = " UNION ALL ".join(
    f"SELECT '{v}' AS variant, [{', '.join(repr(w) for w in ws) or 'NULL'}]::VARCHAR[] AS ws" for v, ws in steps.VARIANT_WORDS.items())
query("simulate_ablation", "pipeline:i variant pos description", f"""
WITH {STEPS}, v AS ({_GONE}), m AS (SELECT pipeline, pos, concat(name, '->', class) AS description, variant,
  coalesce(list_bool_or(list_transform(ws, lambda w: contains(lower(concat(name, '->', class)), w))), FALSE) AS gone FROM steps, v),
e AS (SELECT *, bool_and(gone) OVER (PARTITION BY pipeline, variant) AS empty, max(pos) OVER (PARTITION BY pipeline, variant) AS last FROM m)
SELECT pipeline, variant, pos, description FROM e WHERE NOT gone OR (empty AND pos = last)""")(
    lambda t: steps.simulate_ablation(ordered_steps(t).selectExpr("pipeline", "pos", "concat(name, '->', class) as description")))
