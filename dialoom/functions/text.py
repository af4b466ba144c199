"""Column functions over segment texts; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import lexicon as X


def matches(text: Column, pattern: str) -> Column:
    """Unicode classes, and a dot that stops at line feeds only."""
    return F.regexp_like(text, F.lit("(?dU)" + pattern))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def meaningful_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(X.MEANINGFUL)).cast("int")


def question_strength(text: Column) -> Column:
    bare = compact(text)
    word = matches(bare, X.QUESTION_WORD)
    terms = [
        F.when(matches(text, X.QUESTION_MARK), 2.0).otherwise(0.0),
        F.when(matches(text, X.INTERVIEWER_CONTROL), 2.0).otherwise(0.0),
        F.when(matches(bare, X.QUESTION_START) & word, 1.5).otherwise(0.0),
        F.when(matches(bare, X.QUESTION_END), 1.5).otherwise(0.0),
        F.when(word, F.when(meaningful_count(bare) <= 30, 1.0).otherwise(0.2)).otherwise(0.0),
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def is_acknowledgement(text: Column) -> Column:
    bare = compact(text)
    return bare.isin(*X.ACKNOWLEDGEMENTS) | matches(bare, X.ACKNOWLEDGEMENT)


def v1_question_score(text: Column) -> Column:
    return matches(text, X.QUESTION_MARK).cast("int") + matches(text, X.V1_QUESTION).cast("int")


def mostly_one(chars: Column, share: float) -> Column:
    """Whether one character makes up ``share`` (above a half) of ``chars`` or more: such a one stands in the
    middle of them all when they are sorted, so that one is counted."""
    middle = F.get(F.array_sort(F.split(chars, "")), F.floor(F.length(chars) / 2).cast("int"))
    return (F.length(chars) - F.length(F.replace(chars, middle, F.lit("")))) / F.length(chars) >= share


def normalize_text(text: Column, replacements: dict[str, str] | None = None) -> Column:
    """Collapse white space, apply spellings longest first, drop spaces before punctuation.

    Texts that hold no spelling at all, case aside, are told by one pattern and go round the chain."""
    keys = sorted(replacements if replacements is not None else X.REPLACEMENTS, key=len, reverse=True)
    plain = out = one_spaced(text)
    for key in keys:
        value = (replacements or X.REPLACEMENTS)[key].replace("\\", "\\\\").replace("$", "\\$")
        quoted = "\\Q" + key + "\\E"
        out = F.regexp_replace(out, f"(?i)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if key.isascii() else quoted, value)
    if keys:
        some = "(?i)" + "|".join("\\Q" + key + "\\E" for key in keys)
        out = F.when(F.regexp_like(plain, F.lit(some)), out).otherwise(plain)
    return closed_up(out)


def one_spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def closed_up(text: Column) -> Column:
    """Without white space around it and before punctuation."""
    return stripped(F.regexp_replace(text, r"(?U)\s+([，。！？；：、,.!?;:])", "$1"))


def format_timestamp(seconds: Column) -> Column:
    ms = F.greatest(F.lit(0), F.rint(seconds * 1000).cast("long"))
    whole = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ms % 1000)


def topic(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """(label, keywords): the label of most substring hits, first of the dictionary on ties.

    The text is lowered once and the best label found once, also where the expression is interpreted;
    words are lowered when the plan is made."""
    named = topics or X.TOPICS
    labels = F.array(*[F.lit(label) for label in named])
    none = F.struct(F.lit(X.UNCLASSIFIED).alias("label"), F.array().cast("array<string>").alias("keywords"))

    def held(low: Column, words: list[str]) -> Column:
        each = F.array(*[F.struct(F.lit(w).alias("word"), F.lower(F.lit(w)).alias("low")) for w in words]) if words else F.array().cast("array<struct<word:string,low:string>>")
        return F.transform(F.filter(each, lambda w: F.contains(low, w["low"])), lambda w: w["word"])

    def best(low: Column) -> Column:
        hits = [held(low, words) for words in named.values()]
        return F.array_max(F.transform(F.array(*hits), lambda k, i: F.struct(F.size(k).alias("n"), (-i).alias("pos"), k.alias("keywords"))))

    told = lambda b: F.when(b["n"] == 0, none).otherwise(F.struct(F.get(labels, -b["pos"]).alias("label"), b["keywords"].alias("keywords")))
    return F.get(F.transform(F.transform(F.array(F.lower(text)), best), told), F.lit(0))


def keyword_similarity(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def with_redactions(df: DataFrame, name: str, terms: list[str] | None = None) -> DataFrame:
    """Adds n_<kind> for each kind of personal data (and n_custom), and redacts ``name`` in place.

    A kind is counted in what earlier kinds left; custom terms come last, longest first.  Each
    step is a projection of its own, so no expression is evaluated again for a later kind."""
    custom = sorted({t.strip() for t in terms or [] if t and t.strip()}, key=lambda t: (-len(t), t))
    kinds = [(k, "(?U)" + p) for k, p in X.PERSONAL] + ([("custom", "|".join(re.escape(t) for t in custom))] if custom else [])
    for kind, pattern in kinds:
        parts = F.split(F.col(name), pattern, -1)
        df = df.withColumn("_parts", parts).withColumn(f"n_{kind}", (F.size("_parts") - 1).cast("long"))
        df = df.withColumn(name, F.array_join("_parts", f"[REDACTED_{kind.upper()}]")).drop("_parts")
    return df


def redacted(text: Column, terms: list[str] | None = None) -> Column:
    """Placeholders without ordinals; custom terms last, longest first."""
    for name, pattern in X.PERSONAL:
        text = F.regexp_replace(text, "(?U)" + pattern, f"[REDACTED_{name.upper()}]")
    terms = sorted({t.strip() for t in terms or [] if t and t.strip()}, key=lambda t: (-len(t), t))
    return F.regexp_replace(text, "|".join(re.escape(t) for t in terms), "[REDACTED_CUSTOM]") if terms else text


def distinct_strings(values: Column) -> Column:
    """First occurrences, in order, of strings that are not empty."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def inline_code(text: Column) -> Column:
    return F.translate(F.replace(html_escaped(text), F.lit("`"), F.lit("&#96;")), "\r\n", "  ")


def safe_stem(name: Column) -> Column:
    """Letters, digits and . _ - of a name, other runs as one dash, 64 characters at most."""
    bare = F.regexp_replace(name, r"[^A-Za-z0-9._一-鿿-]+", "-")
    stem = F.substring(F.regexp_replace(bare, r"^[-._]+|[-._]+$", ""), 1, 64)
    return F.when(stem == "", "interview").otherwise(stem)


def session_id(path: Column) -> Column:
    """Safe stem of a path's last part and eight digits of the path's digest."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.when(F.regexp_like(name, F.lit(r".\.[^.]*$")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.concat(safe_stem(stem), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def markdown_escaped(text: Column) -> Column:
    text = F.replace(html_escaped(text), F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"([`*_\[\]])", r"\\$1")
    return F.regexp_replace(text, r"\r\n|\r|\n", "<br>")
