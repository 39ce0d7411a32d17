"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The document type of each category folder, and the default.
DOCUMENT_TYPES = {"world": "worldbuilding", "cultures": "culture", "factions": "faction", "characters": "character", "timeline": "chronicle", "locations": "location", "uncategorized": "misc"}
DEFAULT_TYPE = "lore"

# Credential patterns and what takes their place, in the order
# in which they apply.
_SECRET_NAME = r"(?:API[_-]?KEY|ACCESS[_-]?KEY|TOKEN|PASSWORD|PASSWD|PASSPHRASE|SECRET|CREDENTIAL)"
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "<redacted-private-key>"),
    (r"(?i)\b(https://(?:hooks\.slack\.com/services|discord(?:app)?\.com/api/webhooks)/)[^\s\"'<>]+", "$1<redacted>"),
    (r"(?i)\b((?:https?|ftp|amqps?|postgres(?:ql)?|neo4j|mongodb(?:\+srv)?|mysql|redis)://[^:/@\s]+:)([^@/\s]+)(@)", "$1<redacted>$3"),
    (rf"(?i)([?&][A-Z0-9_.-]*{_SECRET_NAME}[A-Z0-9_.-]*=)([^&#\s]+)", "$1<redacted>"),
    (r"(?im)\b((?:proxy-)?authorization|cookie|set-cookie|x-api-key|api-key)([ \t]*:[ \t]*)([^\r\n]+)", "$1$2<redacted>"),
    (r"(?i)\b(Bearer|Basic)([ \t]+)([A-Za-z0-9._~+/=-]{8,})", "$1$2<redacted>"),
    (rf"""(?i)(["']?[A-Z0-9_.-]*{_SECRET_NAME}[A-Z0-9_.-]*["']?[ \t]*[:=][ \t]*)("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s,;&}}]{{4,}})""", "$1<redacted>"),
    (r"(?i)\b(gh[pousr]_|github_pat_|glpat-|sk[-_](?:live|test)?_?|rk_(?:live|test)_|whsec_|xox[baprs]-|AIza|ya29\.|AKIA|ASIA|ls__|SG\.|npm_|pypi-|hf_|shp(?:at|ss|ca|pa)_|dop_v1_|ddapi_)([A-Za-z0-9._~+/=-]{8,})", "$1<redacted>"),
    (r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b", "<redacted-jwt>"),
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fingerprint(text: Column | str) -> Column:
    """``sha256:v1:<hex>`` of the UTF-8 text."""
    return F.concat(F.lit("sha256:v1:"), F.sha2(_c(text), 256))


def short_id(text: Column | str) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 8)


def alphanumeric(text: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]", "")


def names_match(a: Column | str, b: Column | str) -> Column:
    """Either alphanumeric form holds the other; neither is empty."""
    a, b = alphanumeric(a), alphanumeric(b)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def token_case(name: Column | str) -> Column:
    """camelCase, spaces and dashes to UPPER_SNAKE."""
    x = F.regexp_replace(_c(name), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.trim(F.upper(F.regexp_replace(x, r"[^A-Za-z0-9]+", "_")), F.lit("_"))


def screaming_snake(name: Column | str) -> Column:
    """a relationship name in upper case with single underscores; spaces,
    hyphens and dots part its words."""
    x = F.regexp_replace(_c(name), r"[\s\-.]+", "_")
    x = F.regexp_replace(x, r"[^A-Za-z0-9_]", "")
    return F.trim(F.upper(F.regexp_replace(x, r"_+", "_")), F.lit("_"))


def dedupe_key(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(text), r"\s+", " ")))


_PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"


def capitalised_phrases(text: Column | str) -> Column:
    """runs of capitalised words between word bounds, in order of place."""
    return F.regexp_extract_all(_c(text), F.lit(rf"(?U)\b{_PHRASE}\b"), 0)


def quoted_phrases(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit('"([^"]+)"'), 1)


def phrases_after_the(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(rf"(?U)\bthe\s+({_PHRASE})\b"), 1)


def keywords(text: Column | str) -> Column:
    """at most 10 capitalised, 5 quoted and 5 after-the phrases, 20 in
    all, each once. Which ones are taken is by place (the surveyed set order
    is arbitrary)."""
    kinds = ((capitalised_phrases, 10), (quoted_phrases, 5), (phrases_after_the, 5))
    return F.slice(F.array_distinct(F.concat(*(F.slice(F.array_distinct(f(text)), 1, n) for f, n in kinds))), 1, 20)


def years(text: Column | str) -> Column:
    """Years with an era mark."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(\d{3,4})\s*(?:DR|CR|Age)"), 1), lambda y: y.cast("int"))


def title_of(text: Column | str, path: Column | str) -> Column:
    """The first ``# `` line, or the file name in title case."""
    head = F.trim(F.regexp_extract(_c(text), r"(?m)^# (.*)$", 1))
    stem = F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[^.]*$", "")
    return F.when(head != "", head).otherwise(F.initcap(F.regexp_replace(stem, "[_-]+", " ")))


def summary_of(text: Column | str, most: int = 500) -> Column:
    """Lines that are no headers, until their raw lengths reach ``most``; a
    summary of full length is cut at its last space."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc, line):
        more = F.struct((acc["used"] + F.length(line)).alias("used"), F.concat(acc["kept"], F.array(F.trim(line))).alias("kept"))
        return F.when(acc["used"] < most, more).otherwise(acc)

    joined = F.substring(F.array_join(F.aggregate(lines, start, step)["kept"], " "), 1, most)
    return F.when(F.length(joined) < most, joined).otherwise(F.concat(F.regexp_replace(joined, r" [^ ]*$", ""), F.lit("...")))


def document_type(path: Column | str) -> Column:
    """By the category folder below ``canon``, or by the parent folder."""
    parts = F.split(_c(path), "/")
    known = F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv])
    below = F.when(F.array_contains(parts, "canon"), F.try_element_at(parts, (F.array_position(parts, "canon") + 1).cast("int")))
    parent = F.try_element_at(parts, F.lit(-2))
    return F.coalesce(F.try_element_at(known, below), F.try_element_at(known, parent), F.lit(DEFAULT_TYPE))


def line_count(text: Column | str) -> Column:
    return F.length(_c(text)) - F.length(F.replace(_c(text), F.lit("\n"))) + 1


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))


def conversation_title(text: Column | str, most: int = 50) -> Column:
    """The text, or its start up to the last space and an ellipsis."""
    x = F.trim(_c(text))
    start = F.substring(x, 1, most)
    cut = F.when(start.contains(" "), F.regexp_replace(start, " [^ ]*$", "")).otherwise(start)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut, F.lit("...")))


def title_label(name: Column | str) -> Column:
    return F.initcap(F.replace(_c(name), F.lit("_"), F.lit(" ")))


def redact(text: Column | str) -> Column:
    """Credentials replaced, by the ordered patterns."""
    x = _c(text)
    for pattern, put in REDACTIONS:
        x = F.regexp_replace(x, pattern, put)
    return x


# The spaces of Unicode (category Zs), which DuckDB's trim takes off too.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def bounded_message(text: Column | str, most: int = 512, default: str | None = "unknown error") -> Column:
    """Control characters to single spaces, none at the ends, at most ``most``
    characters. A text without any other reads ``default``; if that is None, it
    stays blank, or null."""
    x = F.substring(F.trim(F.regexp_replace(_c(text), r"[\x00-\x1F\x7F\s]+", " "), F.lit(SPACES)), 1, most)
    return x if default is None else F.when(x.isNull() | (x == ""), default).otherwise(x)


def backoff_seconds(key: Column, attempt: Column, base: int = 30, most: int = 3600) -> Column:
    """Exponential delay with a jitter of 0.8 to 1.2 that a hash of key and
    attempt fixes; rounded half to even."""
    digest = F.sha2(F.concat_ws(":", key, attempt.cast("string")), 256)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") for at in (1, 9))
    fraction = (high * F.lit(2.0**32) + low) / F.lit(float(2**64 - 1))
    raw = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))))
    return F.greatest(F.lit(1), F.least(F.lit(most), F.bround(raw * (F.lit(0.8) + F.lit(0.4) * fraction), 0).cast("int")))


def uuid_in(text: Column | str) -> Column:
    """The first UUID of a description, in lower case; null without one."""
    found = F.lower(F.regexp_extract(_c(text), r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1))
    return F.when(found != "", found)


def is_identifier(name: Column | str) -> Column:
    return _c(name).rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def is_fingerprint(text: Column | str) -> Column:
    return _c(text).rlike("^sha256:v1:[0-9a-f]{64}$")


def first_json(text: Column | str) -> Column:
    """The text from the first brace to the last."""
    return F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)


def sentence_complexity(sentence: Column | str) -> Column:
    """Mean of the word-length part (of 6, at most 2) and the sentence-length
    part (of 20 words, at most 1.5); 1 without words."""
    words = F.filter(F.split(_c(sentence), r"\s+"), lambda w: w != "")
    n = F.size(words)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return F.when(n == 0, 1.0).otherwise((F.least(F.try_divide(letters, n) / 6, F.lit(2.0)) + F.least(n / 20, F.lit(1.5))) / 2)


def dynamic_most_tokens(sentences: Column, base: int = 200, most: int = 500) -> Column:
    """The size limit of a document from the mean complexity of its first 20
    sentences."""
    few = F.slice(sentences, 1, 20)
    mean = F.try_divide(F.aggregate(few, F.lit(0.0), lambda a, s: a + sentence_complexity(s)), F.size(few))
    size = F.when(mean > 1.2, int(most * 1.2)).when(mean > 1.0, most).otherwise(max(int(most * 0.8), base * 2))
    return F.when(F.size(sentences) == 0, most).otherwise(F.greatest(F.lit(int(base * 1.5)), F.least(size, F.lit(most * 2))))


def retry_after_seconds(value: Column | str, milliseconds: Column | None = None, now: Column | None = None) -> Column:
    """the wait that a response asks for. A valid number in its
    milliseconds header comes first; then a number of seconds, or an HTTP date
    against ``now``, neither below zero; null for anything else."""
    date = F.try_to_timestamp(F.regexp_replace(F.trim(_c(value)), r"^[A-Za-z]{3},\s*|\s*(?:GMT|UTC)$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    until = F.unix_micros(date) / 1e6 - F.unix_micros(F.current_timestamp() if now is None else now) / 1e6
    number = F.coalesce(F.trim(_c(value)).try_cast("double"), until)
    given = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).when(number < 0, 0.0).otherwise(number)
    if milliseconds is None:
        return given
    ms = F.trim(milliseconds).try_cast("double") / 1000
    return F.when((ms >= 0) & ~F.isnan(ms) & (ms != float("inf")), ms).otherwise(given)
