"""Column builders over text: numbers, log masks, SQL shapes, severities, tokens, small normalisers."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks in the order in which they apply, level names and what stands for each, hints used without a level.
MASKS = [
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TIME>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TIME>"),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", "<DATE>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<IP>"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<EMAIL>"),
    (r"(?i)\b0x[0-9a-f]+\b", "<HEX>"),
    (r"(?i)\b[0-9a-f]{16,}\b", "<HEX>"),
    (r"(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/])+[\w.-]*", "<PATH>"),
    (r"(?i)\b\d+(?:\.\d+)?(?:ms|s|sec|kb|mb|gb|%)\b", "<NUM>"),
    (r"\b\d+(?:\.\d+)?\b", "<NUM>"),
]
LEVELS = {
    "FATAL": ["FATAL", "EMERGENCY", "EMERG", "CRITICAL", "CRIT", "PANIC", "SEVERE", "ALERT"],
    "ERROR": ["ERROR", "ERR", "SEVERE_ERROR"],
    "WARN": ["WARNING", "WARN"],
    "INFO": ["INFORMATION", "INFO", "NOTICE"],
    "DEBUG": ["DEBUG", "TRACE", "VERBOSE", "FINE", "FINEST"],
}
CONTENT_HINTS = [
    ("FATAL", r"(?i)\b(kernel panic|out of memory|oom[-_]?kill|segfault|segmentation fault|core dumped|stack overflow)\b"),
    ("ERROR", r"(?i)\b(exception|traceback|failed to|failure|refused|aborted|cannot|could not|denied)\b"),
    ("WARN", r"(?i)\b(deprecat(ed|ion)|retry(ing)?|slow|throttl(ed|ing))\b"),
]
#: A word's edge where words are of ASCII letters, digits and _ only; that of Java's \b depends on its version.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# Filler phrases, error classes, entities, terms and words without weight.
FILLERS = [
    r"(?i)\b(please|kindly|do me a favor|if you don't mind)\b",
    r"(?i)\b(can you|could you|would you|will you)\s+(please\s+)?(help me\s+)?",
    r"(?i)\b(i would like you to|i want you to|i need you to)\s+",
    r"(?i)\b(help me (to\s+)?|guide me (to\s+)?|assist me (in\s+)?)",
    r"(?i)\b(as an ai|as a language model|as chatgpt|as claude)\b",
    r"(?i)\b(i hope (you are )?(doing well|fine)\.?\s*)",
    r"(?i)\b(thank you( in advance)?\.?\s*)",
]
ERROR_CLASSES = [
    ("request_too_large", "(?i)413|too large|request too large|context length|maximum context|context_length_exceeded|tokens"),
    ("quota_exhausted", "(?i)quota|insufficient|credit|billing|exceeded"),
    ("rate_limited", "(?i)rate limit|429|too many"),
    ("model_unavailable", "(?i)decommissioned|does not exist|unsupported|model[_ ]?not[_ ]?found|not_found_error|no such model|invalid model"),
    ("api_key_missing", "(?i)api key|authentication|unauthorized|401"),
    ("connection", "(?i)ECONNREFUSED|Connection"),
    ("server", "(?i)ENOTFOUND|DNS"),
    ("timeout", "(?i)timeout"),
]
ENTITY_PATTERNS = {
    "person": r"\b[A-Z][a-z]+ (?:[A-Z][a-z]+)*\b",
    "date": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}|\d{4}\b",
    "number": r"\b\d+(?:,\d{3})*(?:\.\d+)?\b",
}
TERM = r"\b(?:[A-Z][a-zA-Z0-9_-]{2,}|[A-Z]{2,}|\d[\d.,%-]*|[a-z][a-z0-9_-]{4,})\b"
STOPWORDS = "there their about would could should after before where which while using please thanks summary conversation".split()
RANK_TOKEN = "[a-z0-9]+(?:[._-][a-z0-9]+)*"
UNIT = r"(?i)\s*(?:msec|ms|secs?|s|us|ns|min)\.?$"
NUMBER = r"^[+-]?\d*\.?\d+(?:[eE][+-]?\d+)?$"


def to_number(cell: Column) -> Column:
    """A cell as a number: separators before a digit and a trailing time unit are dropped (``1,5`` is 15); null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(cell), "[,_ ](?=[0-9])", ""), UNIT, "")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def mask(line: Column) -> Column:
    """A log line with times, addresses, ids, paths and numbers replaced by their kind."""
    return reduce(lambda out, m: F.regexp_replace(out, m[0], m[1]), MASKS, line)


def severity(line: Column) -> Column:
    """The level that a line states in its first 200 characters, else what its words suggest, else null."""
    names = "|".join(sorted((a for v in LEVELS.values() for a in v), key=len, reverse=True))
    stated = rf'(?i)(?:\[\s*({names})\s*\]|\b(?:level|severity|lvl|loglevel)"?\s*[=:]\s*"?({names})"?|(?:^|\s)({names})(?=\s|:|\]|$))'
    head = F.substring(line, 1, 200)
    token = F.upper(F.concat(*[F.regexp_extract(head, stated, k) for k in (1, 2, 3)]))
    level = F.coalesce(*[F.when(token.isin(v), k) for k, v in LEVELS.items()])
    return F.coalesce(level, *[F.when(head.rlike(p), k) for k, p in CONTENT_HINTS])


def timestamp(line: Column) -> Column:
    """The first timestamp of a line in one of three forms, else null."""
    iso = F.regexp_extract(line, r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)", 1)
    slashed = F.regexp_extract(line, r"\b(\d{4}/\d{2}/\d{2}[ T]\d{2}:\d{2}:\d{2})", 1)
    access = F.regexp_extract(line, r"\b(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(iso, ",", "."), " ", "T")),
        F.try_to_timestamp(F.regexp_replace(slashed, "T", " "), F.lit("yyyy/MM/dd HH:mm:ss")),
        F.try_to_timestamp(access, F.lit("dd/MMM/yyyy:HH:mm:ss")),
    )


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _quotes_and_comments(sql: Column) -> Column:
    """A statement without comments, its quoted literals ``?`` (``'%?'`` with a leading %).

    A step runs only where its mark is in the statement, which none of the steps brings in. Literals are stretches without a quote
    joined by doubled ones, so that long ones aren't searched in depth.
    """
    has = lambda *marks: reduce(lambda a, b: a | b, [F.contains(sql, F.lit(m)) for m in marks])
    out = sql
    for mark, comment in (("--", r"--[^\n]*"), ("/*", r"(?s)/\*.*?\*/")):
        out = F.when(has(mark), F.regexp_replace(out, comment, " ")).otherwise(out)
    for q in "'\"":
        literal = f"[^{q}]*(?:{q}{q}[^{q}]*)*{q}"
        leading = F.replace(F.regexp_replace(F.regexp_replace(out, f"{q}%{literal}", "\u0001"), f"{q}{literal}", "?"), F.lit("\u0001"), F.lit(f"{q}%?{q}"))
        out = F.when(has(f"{q}%", "\u0001"), leading).when(has(q), F.regexp_replace(out, f"{q}{literal}", "?")).otherwise(out)
    return F.coalesce(out, F.lit(""))


def rough_shape(sql: Column) -> Column:
    """A statement of the same ``fingerprint`` in which quoted literals and freestanding whole numbers are alike; cheap to find.

    The steps stand in a function of the statement, as generated code of all their branches is too long to be compiled well.
    """
    def bare(s: Column) -> Column:
        marked = reduce(lambda a, b: a | b, [F.contains(s, F.lit(m)) for m in ("'", '"', "--", "/*")])
        return F.regexp_replace(F.when(marked, _quotes_and_comments(s)).otherwise(s), r"\d(?<![\w.]\d)\d++(?![\w.])", "0")

    return _with(sql, bare)


def _one_branch_each(sql: Column) -> Column:
    """A squeezed statement without the UNION branches that stand in what precedes them."""
    branch = lambda piece: F.trim(F.regexp_replace(piece, r"^UNION(?:\s+ALL)?\s+", ""))
    new = lambda pieces: F.filter(pieces, lambda piece, k: (k == 0) | ~F.contains(F.array_join(F.slice(pieces, F.lit(1), k), ""), branch(piece)))
    return F.array_join(_with(F.split(sql, r"(?=\bUNION(?:\s+ALL)?\s)"), new), "")


def fingerprint(sql: Column) -> Column:
    """The shape of a statement: comments dropped, literals ``?`` (a leading % stays), lists of any length and repeated UNION branches alike."""
    steps = [(r"\b0x[0-9a-fA-F]+\b", "?"), (r"(?i)\bNULL\b", "?"), (r"\b\d+\.?\d*([eE][+-]?\d+)?\b", "?"), (r"_\d{2,}(?=_|\b)", "_?"), (r"\s+", " ")]
    out = F.upper(F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, _quotes_and_comments(sql))))
    lists = [(r"\bIN\s*\(\s*\?(?:\s*,\s*\?)*\s*\)", "IN (?)"), (r"\(\s*\?(?:\s*,\s*\?)*\s*\)", "(?)"), (r"\bVALUES\s*\(\?\)(?:\s*,\s*\(\?\))+", "VALUES (?)")]
    out = _one_branch_each(reduce(lambda c, s: F.regexp_replace(c, *s), lists, out))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), [(r"^USE\s+\S+", "USE ?"), (r"\s+", " ")], out))


def is_sql(cell: Column) -> Column:
    return cell.rlike(r"(?i)^\s*(select|insert|update|delete|merge|with|call|exec|use)\b")


def rank_tokens(text: Column) -> Column:
    """Lower-cased words for ranking; dots, dashes and underscores join a word."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RANK_TOKEN), F.lit(0))


def _stripped(text: Column) -> Column:
    """A text without the white space (that of \\s) at its ends; without a regular expression, which would look at every space of a text."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def token_estimate(text: Column) -> Column:
    """The greater of characters / 4 (/ 3 where over 15 % of the first 4000 are symbols) and 1.3 words, both rounded up."""
    def told(bare: Column) -> Column:
        sample = F.substring(bare, 1, 4000)
        dense = F.length(F.regexp_replace(sample, r"[A-Za-z0-9 \t\n\r]", "")) / F.length(sample) > 0.15
        chars = F.ceil(F.length(bare) / F.when(dense, 3).otherwise(4))
        words = F.ceil(F.size(F.split(bare, r"\s+")) * F.lit(13) / 10)
        return F.when(F.length(bare) == 0, 0).otherwise(F.greatest(chars, words)).cast("bigint")

    return _with(_stripped(F.coalesce(text, F.lit(""))), told)


def compress_prompt(text: Column) -> Column:
    """A prompt without filler phrases; short prompts, and those that would lose over half, stay as they are."""
    out = reduce(lambda c, p: F.regexp_replace(c, p.replace(r"\b", EDGE), ""), FILLERS, text)
    out = F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"^\s+|\s+$", "")
    return F.when((F.length(text) < 50) | (F.length(out) < F.length(text) * 0.5), text).otherwise(out)


def error_class(message: Column) -> Column:
    return F.coalesce(*[F.when(message.rlike(p), k) for k, p in ERROR_CLASSES], F.lit("unknown"))


def normalize_name(name: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " ")
    return F.trim(F.regexp_replace(squeezed, r"^[^a-z0-9]+|[^a-z0-9)\]]+$", ""))


def _accented() -> tuple[str, str]:
    """Letters below U+2000 that are a plain letter with combining marks, and those plain letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def normalize_header(name: Column) -> Column:
    """A header without accents; marks other than _ ( ) [ ] . / - become spaces."""
    plain = F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), *_accented()), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(plain, r"[^A-Za-z0-9_\s()\[\]./-]", " "))


def looks_like_date(cell: Column) -> Column:
    """Whether a cell begins with a date that exists, year first or month first; a time alone is none."""
    parts = lambda pattern: F.array_join(F.array(*[F.regexp_extract(cell, pattern, k) for k in (1, 2, 3)]), "-")
    year_first = F.try_to_timestamp(parts(r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})"), F.lit("y-M-d"))
    month_first = F.try_to_timestamp(parts(r"^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})"), F.lit("M-d-y"))
    shaped = cell.rlike(r"^\s*(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})")
    return F.when(shaped, F.coalesce(year_first, month_first).isNotNull()).otherwise(False)


def urls(text: Column) -> Column:
    """Distinct http(s) addresses in a text, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit("(?i)https?://[^\\s<>\"'`]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[),.;!?]+$", "")))


def canonical_url(url: Column) -> Column:
    parts = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+[^?#]*)", 1)
    return F.lower(F.regexp_replace(F.when(parts != "", parts).otherwise(F.trim(url)), "/+$", ""))


def mentions(text: Column) -> Column:
    """Names after @, plain or quoted, without all, web and here."""
    found = F.regexp_extract_all(text, F.lit(r'@([a-zA-Z0-9_.\-]+|"[^"]+")'), F.lit(1))
    names = F.transform(found, lambda m: F.trim(F.regexp_replace(m, '"', "")))
    return F.filter(names, lambda m: ~F.lower(m).isin("all", "web", "here"))


# The shapes of a tool call at the start of a reply, and of an end without its call.
TOOL_CALLS = [
    r"\[QUERY_DB\].*?(?:\[/QUERY_DB\]|</SQL_QUERY>|</QUERY_DB>)",
    r"<QUERY_DB>.*?\[/QUERY_DB\]",
    r"<QUERY_DB>.*?</QUERY_DB>",
    r"(?i:<query>.*?</query>)",
    r'(?i:<Function\s+id="query_db_\d+"\s*>.*?</Function>)',
    r"\[GET_SCHEMA:[^\]]+\]",
    r"<GET_SCHEMA:[^>]+>",
    r"<GET_SCHEMA>[^<]+</GET_SCHEMA>",
    r"(?i:<DB_SCHEMA_REQUEST>.*?</DB_SCHEMA_REQUEST>)",
    r"(?i:\[DB_SCHEMA_REQUEST:?[^\]]+\])",
    r"(?i:<request[^>]*>.*?</request>)",
    r"(?i:<request_label>Get\s+Schema</request_label>\s*<request_text>[^<]+</request_text>)",
    r"\[SEARCH_FILES:query=[^\]]+\]",
    r"\[GET_FILE:id=[^\]]+\]",
    r"(?i:\[WEB_SEARCH:[^\]]+\])",
    r"(?i:\[EXECUTE_CODE\].*?\[/EXECUTE_CODE\])",
]
TOOL_ENDS = [r"\[/QUERY_DB\]", r"</QUERY_DB>", r"(?i:</query>)", r"</SQL_QUERY>", r"(?i:</Function>)"]


def strip_tool_tags(text: Column) -> Column:
    """A reply without the tool calls that it opens with, and without one end of each kind left behind, in their order."""
    bare = F.regexp_replace(text, rf"(?s)^(?:\s*(?:{'|'.join(TOOL_CALLS)}))+", "")
    bare = reduce(lambda c, end: F.regexp_replace(c, rf"^\s*{end}", ""), TOOL_ENDS, bare)
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def sanitize(text: Column) -> Column:
    """Text without tags and control characters, entities of the five marks decoded first."""
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
    decoded = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)
    return F.trim(F.regexp_replace(F.regexp_replace(decoded, "<[^>]*>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def query_key(query: Column, model: Column, user: Column, topic: Column) -> Column:
    """SHA-256 of a squeezed, lower-cased query with its model, user and topic."""
    squeezed = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    return F.sha2(F.concat_ws("::", squeezed, model, F.coalesce(user, F.lit("")), F.coalesce(topic, F.lit(""))), 256)


def json_object(text: Column) -> Column:
    """The fenced JSON block of a reply, else what lies between the first and the last brace."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def truncate(text: Column, most: int = 160) -> Column:
    """A text on one line, cut after ``most`` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def figure(x: Column) -> Column:
    """A number for reading: digits in groups of three, two places below 100, none above, halves up; n/a if it is none."""
    value = x.cast("double")
    places = F.when(F.abs(value) >= 100, F.floor(value + 0.5).cast("double")).otherwise(F.floor(value * 100 + 0.5) / 100)
    shown = F.regexp_replace(F.format_number(places, 2), r"\.0+$|(?<=\.[0-9])0$", "")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.when(shown == "-0", "0").otherwise(shown)).otherwise("n/a")


def trim_to_tokens(text: Column, most: int | Column) -> Column:
    """The start of a text whose estimate fits ``most`` tokens, with ... where it was cut.

    The first length follows from the text's own characters a token, less 16; up to six times a tenth less is tried.
    """
    most = F.lit(most) if isinstance(most, int) else most
    start = lambda length: _stripped(F.substring(text, F.lit(1), length.cast("int")))

    def shrunk(length: Column, left: int) -> Column:
        if not left:
            return start(length)
        shorter = _with(F.floor(length * 0.9), lambda shorter: shrunk(shorter, left - 1))
        return _with(start(length), lambda cut: F.when(token_estimate(cut) <= most, cut).otherwise(shorter))

    def fitting(tokens: Column) -> Column:
        first = F.greatest(F.lit(0), F.floor(most * (F.length(text) / F.greatest(F.lit(1), tokens))) - 16)
        return F.when(tokens <= most, text).otherwise(F.concat(_with(first, lambda length: shrunk(length, 6)), F.lit("...")))

    return F.when((F.coalesce(text, F.lit("")) == "") | (most <= 0), "").otherwise(_with(token_estimate(text), fitting))


def temporal_context(at: Column, zone: str = "UTC", quantum_s: int = 60) -> Column:
    """A moment as a reader in ``zone`` has it, cut to ``quantum_s`` seconds: date, time, weekday, offset, ISO week, quarter.

    The session's time zone must be UTC.
    """
    cut = F.timestamp_seconds(F.floor(F.unix_timestamp(at) / quantum_s) * quantum_s)
    local = F.from_utc_timestamp(cut, zone)
    minutes = F.floor((F.unix_timestamp(local) - F.unix_timestamp(cut)) / 60)
    offset = F.format_string("UTC%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.struct(
        F.lit(zone).alias("zone"), offset.alias("offset"), F.date_format(local, "EEEE").alias("weekday"), F.date_format(local, "yyyy-MM-dd").alias("local_date"), F.date_format(local, "HH:mm").alias("local_time"),
        F.date_format(local, "EEEE, d MMMM yyyy, HH:mm").alias("local_long"), F.date_format(cut, "yyyy-MM-dd'T'HH:mm'Z'").alias("utc"),
        F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), local), F.weekofyear(local)).alias("iso_week"), F.format_string("Q%d %d", F.quarter(local), F.year(local)).alias("quarter"),
    )


def coerced(value: Column, kind: str) -> Column:
    """A JSON string's text as ``kind``, number or boolean: the number that it begins with (null if none), true or 1."""
    if kind == "boolean":
        return (F.lower(value) == "true") | (value == "1")
    if kind == "number":
        return F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return value


#: How the types of JSON values are written by schema_of_variant.
JSON_KINDS = {"string": "STRING", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def schema_errors(json: Column, schema: dict[str, str], partial: bool = False) -> Column:
    """What a JSON object lacks of ``schema`` (field -> kind): an array of messages, null for a text that isn't JSON."""
    parsed = F.try_parse_json(json)
    found = []
    for field, kind in schema.items():
        told = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
        found.append(F.when(told.isNull(), F.lit(None if partial else f"{field}: missing")).when(~told.rlike(f"^(?:{JSON_KINDS[kind]})"), F.lit(f"{field}: not {kind}")))
    return F.when(parsed.isNotNull(), F.filter(F.array(*found), lambda e: e.isNotNull()))
