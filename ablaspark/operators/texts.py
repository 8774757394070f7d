"""Text and log mining: whole texts, JVM-side string functions, no cap on lengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q

# Metric words in the order they are tried.
METRIC_WORDS = ["accuracy", "final validation performance", "score", "mse", "rmse", "mean squared error"]
_NUMBER = "([0-9]*[.]?[0-9]+)"
_SIGNED = "([-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def extract_metrics(df: DataFrame, text: str, keep: Sequence[str], compat: bool = True) -> DataFrame:
    """(keep..., line_no, metric, value, line) for lines that mention a metric.

    The words are tried in their order, unanchored, so ``rmse: x`` is found as mse, and sign
    and exponent are dropped; a line with a metric word but no ``word: number`` gives its
    first number as 'generic'. ``compat=False`` matches whole words, longest first, and
    reads signed numbers with exponents.
    """
    maybe = df.where(" or ".join(f"contains(lower({q(text)}), '{w}')" for w in METRIC_WORDS))
    lines = maybe.selectExpr(*[q(k) for k in keep], f"posexplode(split({q(text)}, '\\r?\\n')) as (__pos, line)").selectExpr(
        *[q(k) for k in keep], "__pos + 1 as line_no", "line", "lower(line) as __low")
    words = METRIC_WORDS if compat else sorted(METRIC_WORDS, key=lambda w: -len(w))
    number = _NUMBER if compat else _SIGNED
    edge = "" if compat else r"\\b"
    hits = lines.where(" or ".join(f"contains(__low, '{w}')" for w in METRIC_WORDS))
    found = {w: f"nullif(regexp_extract(__low, '{edge}{w}\\\\s*[:=]\\\\s*{number}', 1), '')" for w in words}
    first = f"nullif(regexp_extract(line, '{number}', 1), '')"
    value = f"coalesce({', '.join(found.values())}, {first})"
    name = "case " + " ".join(f"when {x} is not null then '{w}'" for w, x in found.items()) + " else 'generic' end"
    return hits.selectExpr(
        *[q(k) for k in keep], "line_no", f"{name} as metric", f"cast({value} as double) as value", "line",
    ).where("value is not null")


def text_quality(df: DataFrame, text: str) -> DataFrame:
    """Add line count, content flags, comment lines and their share."""
    t, low = q(text), f"lower({q(text)})"
    doc = f"(contains({t}, '\"\"\"') or contains({t}, \"'''\"))"
    out = df.withColumns({
        "lines_of_code": F.expr(f"size(split({t}, '\\n'))"),
        "has_comments": F.expr(f"contains({t}, '#') or {doc}"),
        "has_docstring": F.expr(doc),
        "has_imports": F.expr(f"contains({t}, 'import') or contains({t}, 'from')"),
        "has_pipeline": F.expr(f"contains({t}, 'Pipeline')"),
        "has_preprocessor": F.expr(f"contains({low}, 'preprocessor')"),
        "has_feature_engineering": F.expr(f"contains({low}, 'feature')"),
        "has_model": F.expr(f"contains({low}, 'model') or contains({low}, 'classifier')"),
        "has_random_state": F.expr(f"contains({t}, 'random_state')"),
        "comment_lines": F.expr(f"size(filter(split({t}, '\\n'), x -> startswith(trim(BOTH ' \\t\\r' FROM x), '#')))"),
    })
    return out.withColumn("comment_ratio", F.expr("comment_lines / cast(greatest(1, lines_of_code) as double)"))


# Class-name keyword -> reported model name, and the names that count as complex.
MODEL_KEYWORDS = {
    "LogisticRegression": "Logistic Regression",
    "RandomForest": "Random Forest",
    "GradientBoosting": "Gradient Boosting",
    "SVC": "Support Vector Machine",
    "MLPClassifier": "Neural Network (MLP)",
    "DecisionTree": "Decision Tree",
    "KNeighbors": "K-Nearest Neighbors",
    "GaussianNB": "Naive Bayes",
}
COMPLEX_MODELS = ["Random Forest", "Gradient Boosting", "Neural Network (MLP)"]


def keyword_detect(df: DataFrame, text: str, keywords: Mapping[str, str] = MODEL_KEYWORDS,
                   complex_names: Sequence[str] = tuple(COMPLEX_MODELS)) -> DataFrame:
    """Add detected_models (in table order, case-sensitive substring) and complexity."""
    tests = ", ".join(f"case when contains({q(text)}, '{k}') then '{v}' end" for k, v in keywords.items())
    heavy = ", ".join(f"'{c}'" for c in complex_names)
    out = df.withColumn("detected_models", F.expr(f"filter(array({tests}), x -> x is not null)"))
    return out.withColumn("complexity", F.expr(
        f"if(arrays_overlap(detected_models, array({heavy})), 'complex', 'simple')"))


# Labels and patterns of the two key scanners, and one generic token pattern.
SECRET_PATTERNS = {
    "Google API key (AIza...)": r"AIza[0-9A-Za-z_-]{35}",
    "genai.configure(api_key=... )": r"genai\.configure\(api_key=\s*['\"](.*?)['\"]\)",
    "GEMINI_API_TOKEN in file": r"GEMINI_API_TOKEN\s*=\s*['\"](.*?)['\"]",
    "GOOGLE_API_KEY hard-coded": r"GOOGLE_API_KEY\s*=\s*['\"](AIza[0-9A-Za-z_-]{35})['\"]",
    "OpenAI Key (sk-)": r"(?i)sk-[A-Za-z0-9_-]{32,}",
    "Generic API Key (AKIA...)": r"AKIA[0-9A-Z]{16}",
    "Generic token": r"token\s*=\s*['\"]([0-9A-Za-z_-]{16,})['\"]",
}


def secret_scan(df: DataFrame, text: str, keep: Sequence[str], patterns: Mapping[str, str] = SECRET_PATTERNS,
                redact: bool = True) -> DataFrame:
    """(keep..., pattern, match, context, position) for every hit of every pattern.

    The context is 80 characters on each side, line breaks as blanks, 200 characters at
    most. With ``redact`` only the first four characters of a hit are shown, also of other
    hits that fall into the context. Texts without any hit are dropped before positions
    are worked out.
    """
    def lit(p: str) -> str:
        return "r'" + p.replace("'", "\\x27") + "'"

    arrays = ", ".join(
        f"named_struct('pattern', '{n}', 'ms', regexp_extract_all({q(text)}, {lit(p)}, 0))" for n, p in patterns.items())
    raw = df.selectExpr(*[q(k) for k in keep], f"{q(text)} as __t",
                        f"filter(array({arrays}), h -> size(h.ms) > 0) as __found").where("size(__found) > 0")
    # Walk the hits of a pattern in order: each is searched for behind the end of the one before.
    hit = "named_struct('pattern', f.pattern, 'm', m, 'p', p)"
    walk = (
        "aggregate(f.ms, named_struct('at', 1, 'out', cast(array() as array<struct<pattern:string,m:string,p:int>>)),"
        f" (s, m) -> transform(array(locate(m, __t, s.at)), p -> named_struct('at', p + length(m),"
        f" 'out', concat(s.out, array({hit}))))[0], s -> s.out)"
    )
    placed = raw.withColumn("__hits", F.expr(f"flatten(transform(__found, f -> {walk}))"))
    # Masking keeps the length, so positions stay valid and the order of hits does not matter.
    mask = ("aggregate(__hits, __t, (a, h) -> case when length(h.m) > 4 then"
            " overlay(a placing repeat('*', length(h.m) - 4) from h.p + 4 for length(h.m) - 4) else a end)")
    shown = placed.selectExpr(*[q(k) for k in keep], f"{mask if redact else '__t'} as __shown", "inline(__hits)")
    context = ("substring(replace(substring(__shown, greatest(p - 80, 1), p - greatest(p - 80, 1) + length(m) + 80),"
               " '\\n', ' '), 1, 200)")
    match = "concat(substring(m, 1, 4), repeat('*', length(m) - 4))" if redact else "m"
    return shown.selectExpr(*[q(k) for k in keep], "pattern", f"{match} as match", f"{context} as context", "p as position")


def extract_fenced(df: DataFrame, text: str, pick: str = "first") -> DataFrame:
    """Add n_blocks and code: a fenced block (first or longest), else the part from the first
    import statement, else from ``def main``; NULL if there is none."""
    t = q(text)
    out = df.withColumn("__blocks", F.expr(f"regexp_extract_all({t}, r'(?is)```(?:python)?\\s*(.*?)\\s*```', 1)"))
    longest = "array_sort(__blocks, (a, b) -> length(b) - length(a))[0]"
    chosen = "__blocks[0]" if pick == "first" else longest
    from_import = f"nullif(regexp_extract({t}, r'(?s)(?:import\\s+[\\w.,\\s]+|from\\s+[\\w.]+\\s+import\\s+).*', 0), '')"
    from_main = f"nullif(regexp_extract({t}, r'(?s)def main\\(\\):.*', 0), '')"
    return out.withColumns({
        "n_blocks": F.expr("size(__blocks)"),
        "code": F.expr(f"case when size(__blocks) > 0 then {chosen} else coalesce({from_import}, {from_main}) end"),
    }).drop("__blocks")


def token_count(df: DataFrame, text: str, name: str = "estimated_tokens") -> DataFrame:
    """Words between white space; an empty text has none."""
    return df.withColumn(name, F.expr(f"regexp_count({q(text)}, r'\\S+')"))


# File-name prefix -> artifact type, first match wins.
ARTIFACT_PREFIXES = {
    "init_code_": "initialization", "train": "train", "refined": "refinement", "ensemble": "ensemble",
    "pipeline": "pipeline",
}
DEFAULT_ARTIFACT_TYPES = ["initialization", "train", "refinement", "ensemble", "pipeline"]
KNOWN_DATASETS = ["breast_cancer", "wine", "digits", "iris"]


def classify_artifact(df: DataFrame, file: str, name: str = "artifact_type") -> DataFrame:
    whens = " ".join(f"when startswith({q(file)}, '{p}') then '{t}'" for p, t in ARTIFACT_PREFIXES.items())
    return df.withColumn(name, F.expr(f"case {whens} else 'other' end"))


def split_dataset_variant(df: DataFrame, column: str, known: Sequence[str] = tuple(KNOWN_DATASETS)) -> DataFrame:
    """Add dataset and variant: a known name with its rest, else cut at the first underscore."""
    c = q(column)
    ds = " ".join(f"when {c} = '{d}' or startswith({c}, '{d}_') then '{d}'" for d in known)
    rest = " ".join(
        f"when {c} = '{d}' then '' when startswith({c}, '{d}_') then substring({c}, {len(d) + 2})" for d in known)
    return df.withColumns({
        "dataset": F.expr(f"case {ds} when instr({c}, '_') > 0 then substring_index({c}, '_', 1) else {c} end"),
        "variant": F.expr(
            f"case {rest} when instr({c}, '_') > 0 then substring({c}, instr({c}, '_') + 1) else '' end"),
    })


def classify_source(df: DataFrame, path: str, name: str = "method") -> DataFrame:
    p = q(path)
    return df.withColumn(name, F.expr(
        f"case when contains({p}, 'adk') then 'ADK Agent'"
        f" when contains({p}, 'single_shot') or contains({p}, 'gemini') then 'Single Shot' else 'Unknown' end"))


def dataset_from_path(df: DataFrame, path: str, root: str = "results",
                      known: Sequence[str] = tuple(KNOWN_DATASETS)) -> DataFrame:
    """Add dataset_variant: the directory after ``root`` (one deeper below variants*), else the
    first directory named after a known dataset, else 'unknown'."""
    parts = f"split({q(path)}, '/')"
    at = f"array_position({parts}, '{root}')"
    after = f"try_element_at({parts}, cast({at} + 1 as int))"
    deeper = f"try_element_at({parts}, cast({at} + 2 as int))"
    tests = " or ".join(f"p = '{d}' or startswith(p, '{d}_')" for d in known)
    guess = f"get(filter({parts}, p -> {tests}), 0)"
    tag = (f"case when {at} = 0 then 'unknown' when startswith({after}, 'variants')"
           f" then coalesce({deeper}, {after}) else {after} end")
    return df.withColumn("__tag", F.expr(tag)).withColumn("dataset_variant", F.expr(
        f"case when __tag = 'unknown' or startswith(__tag, 'variants') then coalesce({guess}, __tag) else __tag end"
    )).drop("__tag")


# Word in a file name -> dataset and task type, first match wins, iris by default.
NAME_DATASETS = {
    "california": ("california-housing-prices", "regression"),
    "diabetes": ("diabetes", "regression"),
    "digits": ("digits", "classification"),
    "iris": ("iris", "classification"),
    "wine": ("wine", "classification"),
    "breast": ("breast_cancer", "classification"),
}


def dataset_from_name(df: DataFrame, file: str) -> DataFrame:
    def chain(i: int) -> str:
        whens = " ".join(f"when contains({q(file)}, '{w}') then '{v[i]}'" for w, v in NAME_DATASETS.items())
        return f"case {whens} else '{('iris', 'classification')[i]}' end"

    return df.withColumns({"dataset": F.expr(chain(0)), "task_type": F.expr(chain(1))})


def parse_registrations(df: DataFrame, text: str, keep: Sequence[str],
                        marker: str = "Registered external pipeline:") -> DataFrame:
    """(keep..., line_no, file): text behind the first ':' of lines that hold the marker."""
    lines = df.where(f"contains({q(text)}, '{marker}')").selectExpr(
        *[q(k) for k in keep], f"posexplode(split({q(text)}, '\\n')) as (__pos, __line)")
    return lines.where(f"contains(__line, '{marker}')").selectExpr(
        *[q(k) for k in keep], "__pos + 1 as line_no",
        "trim(BOTH ' \\t\\r' FROM substring(__line, instr(__line, ':') + 1)) as file")


def explode_manifest(df: DataFrame, json: str, tasks: Sequence[str] | None = None,
                     runs: Sequence[str] | None = None,
                     types: Sequence[str] | None = tuple(DEFAULT_ARTIFACT_TYPES)) -> DataFrame:
    """Entry rows of manifest texts, filtered by task, run and artifact type."""
    schema = ("entries array<struct<task:string,run_id:string,source:string,destination:string,"
              "artifact_type:string>>")
    rows = df.selectExpr(f"inline(from_json({q(json)}, '{schema}').entries)")
    for column, allowed in (("task", tasks), ("run_id", runs), ("artifact_type", types)):
        if allowed:
            rows = rows.where(F.col(column).isin(list(allowed)))
    return rows
