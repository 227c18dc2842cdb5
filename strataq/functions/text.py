"""Text, path and time expressions (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII letters, and the Turkish letters with their plain forms.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TURKISH, PLAIN = "ıIİçÇğĞöÖşŞüÜ", "iiiccggoossuu"
COMBINING_DOT = "̇"
#: Words too common to search for.
STOP_WORDS = ["acaba", "ama", "ancak", "bana", "bir", "biz", "bu", "çok", "daha", "de", "diye", "gibi", "göre", "hangi", "hem", "her", "hiç", "için", "ile", "ise", "kadar", "mi", "mu", "ne", "neden", "nasıl", "olan", "olarak", "sonra", "şey", "şu", "var", "ve", "veya", "ya", "yani", "yok"]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as NOCASE comparison does."""
    return F.translate(c, UPPER, LOWER)


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def normalize_tr(c: Column) -> Column:
    """Plain letters for Turkish ones, then lower case."""
    return F.lower(F.translate(c, TURKISH, PLAIN))


def fold_name(c: Column) -> Column:
    """Trimmed lower case without combining dots."""
    return F.replace(F.lower(F.trim(c)), F.lit(COMBINING_DOT), F.lit(""))


def words(c: Column) -> Column:
    """Runs of letters, digits and marks in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{M}]+)"), 1)


def significant(c: Column) -> Column:
    """Distinct normalised tokens of three letters or more that are no stop words, in order."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    tokens = F.split(normalize_tr(c), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(tokens, lambda t: (F.char_length(t) >= 3) & ~F.array_contains(F.transform(stop, normalize_tr), t)))


def whole_word(c: Column, word: str) -> Column:
    import re

    return c.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])")


def normalize_path(c: Column) -> Column:
    """A key for a path: one kind of separator, no device prefix, no repeated or trailing separator, lower case."""
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    c = F.regexp_replace(c, r"^//\?/(?:UNC/)?", "//")
    c = F.regexp_replace(c, r"(?<!^)/{2,}", "/")
    c = F.regexp_replace(c, r"(?<=.)/+$", "")
    return F.replace(F.lower(c), F.lit(COMBINING_DOT), F.lit(""))


def parent_dir(c: Column) -> Column:
    """Up to the last separator; a root keeps it; null without one."""
    found = F.regexp_extract(c, r"^(.*)[/\\][^/\\]*$", 1)
    has = c.rlike(r"[/\\]")
    return F.when(has & (found == ""), F.substring(c, 1, 1)).when(has, found)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def folder_label(c: Column) -> Column:
    """The last segment, or all if that is blank."""
    trimmed = F.regexp_replace(c, r"[/\\]+$", "")
    return F.coalesce(F.nullif(base_name(trimmed), F.lit("")), c)


def root_of(c: Column) -> Column:
    """Scheme or drive and the first segment below it."""
    return F.regexp_extract(c, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]*[^/\\]*(?:[/\\][^/\\]+)?)", 1)


def sanitize_folder(c: Column) -> Column:
    """A name fit for a folder: no reserved or control signs, single spaces, no dots or spaces at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[<>:\"/\\|?*\x00-\x1f]", " "), r"\s+", " "), r"^[. ]+|[. ]+$", "")


def remap_prefix(c: Column, old: str, new: str) -> Column:
    """Paths below old (ASCII case aside) moved below new; others unchanged."""
    below = F.startswith(ascii_lower(c), ascii_lower(F.lit(old)))
    return F.when(below, F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(c)


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"(?<=.)\.([^.]+)$", 1)), F.lit(""))


def parse_time(c: Column) -> Column:
    """Epoch seconds of ISO times with offset or fraction, dates, and digits (seconds, or milliseconds
    from twelve digits); null for anything else."""
    c = F.trim(c)
    digits = F.try_to_number(c, F.lit("9" * 18)).cast("long")
    number = F.when(F.char_length(c) >= 12, F.expr("cast(null as long)")).otherwise(digits)
    millis = F.floor(digits / 1000)
    return F.when(c.rlike("^[0-9]{12,18}$"), millis).when(c.rlike("^[0-9]{1,11}$"), number).otherwise(F.try_to_timestamp(c).cast("long"))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """Epoch seconds of a YYYY-MM-DD day's first and last second; null if it is none."""
    at = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("long")
    return at, at + 86_399


def days_ago(days: int) -> Column:
    """Epoch seconds so many days before now; a negative number counts as none."""
    return F.unix_timestamp() - max(0, days) * 86_400


def months_ago(months: int) -> Column:
    """Epoch seconds of the first day of the month so many months before this one."""
    return F.unix_timestamp(F.add_months(F.trunc(F.current_date(), "month"), -months).cast("timestamp"))


def month_label(seconds: Column) -> Column:
    """YYYY-MM of epoch seconds, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def minute_label(seconds: Column) -> Column:
    """YYYY-MM-DD HH:MM of epoch seconds, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def filetime_seconds(ticks: Column) -> Column:
    """Epoch seconds of 100 ns ticks since 1601."""
    return F.floor(ticks / 10_000_000) - 11_644_473_600


def julian_seconds(day: Column, millis: Column) -> Column:
    return (day - 2_440_588) * 86_400 + F.floor(millis / 1000)


def human_bytes(c: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.concat(c.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        out = F.when(c >= 1024**i, F.concat(F.format_number(c / 1024**i, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def percent(part: Column, total: Column) -> Column:
    """Rounded half up; 0 without a total."""
    return F.when(total <= 0, 0).otherwise(F.floor(part * 100.0 / total + 0.5)).cast("long")


def query_component(c: Column) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def json_rows(c: Column) -> Column:
    """The elements of a JSON array of strings; none if it is malformed."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def fuzzy_word(word: Column, term: str) -> Column:
    """Within the edits that a term's length allows: none up to 3 letters, 1 up to 6, else 2."""
    n = 0 if len(term) <= 3 else 1 if len(term) <= 6 else 2
    return (word == term) if not n else F.levenshtein(word, F.lit(term), n) >= 0


def fuzzy_match(c: Column, term: str) -> Column:
    return F.exists(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: fuzzy_word(w, term.lower()))
