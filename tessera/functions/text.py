"""Text expressions: column functions only, so that they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.constants import BINARY_EXTENSIONS, ENVELOPE_TOKENS, FAILURES, METADATA_NAMES, PROSE_EXTENSIONS, PROSE_STEMS

WORD_RUN = r"[\p{L}\p{N}_]{1,4}"
SYMBOL_RUN = r"[^\p{L}\p{N}_\p{IsWhite_Space}]{1,2}"


def estimate_tokens(text: Column) -> Column:
    """A token for four characters of a word and for two of other marks; white space is free and breaks runs."""
    return (F.regexp_count(text, F.lit(WORD_RUN)) + F.regexp_count(text, F.lit(SYMBOL_RUN))).cast("long")


def delivered_tokens(content: Column, path: Column) -> Column:
    return estimate_tokens(content) + estimate_tokens(path) + ENVELOPE_TOKENS


def stem(term: Column) -> Column:
    low, size = F.lower(term), F.octet_length(F.lower(term))
    cut = lambda n: F.substring(low, F.lit(1), F.length(low) - n)
    return (
        F.when(low.endswith("tted") & (size > 6), cut(3))
        .when(low.endswith("ed") & (size > 5) | low.endswith("es") & (size > 4), cut(2))
        .when(low.endswith("s") & (size > 3) & ~low.rlike("(ss|us|is)$"), cut(1))
        .otherwise(low)
    )


def split_words(term: Column) -> Column:
    spaced = F.regexp_replace(term, r"[_\-.:/]+", " ")
    spaced = F.regexp_replace(spaced, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.trim(spaced), " +"), lambda w: w != "")


def intrinsic_weight(term: Column, first: Column) -> Column:
    named = term.rlike(r"(?s)_|::|\.|^.+[A-Z]")
    return F.when(named, 3).when(F.octet_length(term) >= 8, 2).otherwise(1) + F.when(first, 1).otherwise(0)


def content_tokens(text: Column) -> Column:
    """The distinct lower-case tokens of three bytes and more that are not numbers."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda t: (F.octet_length(t) >= 3) & ~t.rlike(r"^\p{N}+$")), F.lower))


def identifier_tokens(text: Column) -> Column:
    """Compound identifiers of four bytes and more."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda t: (F.octet_length(t) >= 4) & t.rlike(r"_|[\p{Ll}0-9]\p{Lu}"))


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_union(left, right))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / both)


def similarity(left: Column, right: Column, same_path: Column) -> Column:
    return F.greatest(jaccard(left, right), F.when(same_path, 0.5).otherwise(0.0))


def cosine(left: Column, right: Column) -> Column:
    """0 where lengths differ or a vector is null or zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when((F.size(left) == F.size(right)) & (norm > 0), dot(left, right) / norm).otherwise(0.0)


def term_match(line: Column, forms: list[str]) -> Column:
    """A form that starts the line or follows no letter or digit; whatever may come after it."""
    return line.rlike(term_pattern(forms))


def term_pattern(forms: list[str]) -> str:
    return r"(?iu)(?:^|[^\p{L}\p{N}])(?:" + "|".join(re.escape(f).replace(r"\-", "-") for f in forms) + ")"


def set_bits_sum(mask: Column, weights: Column) -> Column:
    """The sum of the weights of the set bits."""
    return F.aggregate(F.transform(weights, lambda w, i: F.when(F.getbit(mask, i) == 1, w.cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, w: s + w)


def coverage_weight(mask: Column, weights: Column) -> Column:
    """The strongest set weight and a third of the others."""
    own = F.transform(weights, lambda w, i: F.when(F.getbit(mask, i) == 1, w.cast("long")).otherwise(F.lit(0).cast("long")))
    top = F.array_max(own)
    return top + F.floor((F.aggregate(own, F.lit(0).cast("long"), lambda s, w: s + w) - top) / 3)


def decode_terms(mask: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t, i: F.getbit(mask, i) == 1)


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def is_prose(path: Column) -> Column:
    return extension(path).isin(PROSE_EXTENSIONS) | F.substring_index(file_name(path), ".", 1).isin(PROSE_STEMS)


def is_metadata(path: Column) -> Column:
    name = file_name(path)
    return name.isin(METADATA_NAMES) | name.rlike(r"^[tj]sconfig.*\.jsonc?$") | name.contains(".config.")


def penalised(path: Column, score: Column) -> Column:
    third, half = F.greatest(F.lit(1), F.floor(score / 3)), F.greatest(F.lit(1), F.floor(score / 2))
    return F.when(score <= 0, score).when(is_prose(path), third).when(is_metadata(path), half).otherwise(score).cast("long")


def line_indent(line: Column) -> Column:
    """Leading white space in bytes; null for a blank line."""
    bare = F.regexp_replace(line, r"^\p{IsWhite_Space}+", "")
    return F.when(bare != "", F.octet_length(line) - F.octet_length(bare))


def is_continuation(line: Column) -> Column:
    return line.rlike(r"^\p{IsWhite_Space}*([)\]}]|[{(\[ \t]+$)")


def is_trivial(line: Column) -> Column:
    """Blank, or brackets and separators only."""
    return line.rlike(r"^\p{IsWhite_Space}*[(){}\[\];,]*\p{IsWhite_Space}*$")


def is_annotation(line: Column) -> Column:
    return line.rlike(r"^\p{IsWhite_Space}*(@|#|//|/\*|\*|--|;;)")


def numbered_range(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.transform(F.slice(lines, start, end - start + 1), lambda line, i: F.concat((start + i).cast("string"), F.lit(": "), line)), "\n")


def shell_quoted(path: Column) -> Column:
    """As it is where no shell could misread it; one that begins with a dash never is."""
    return F.when(path.rlike(r"^[\p{L}\p{N}_./][\p{L}\p{N}_./-]*$"), path).otherwise(F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def verify_hint(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("sed -n '"), start.cast("string"), F.lit(","), end.cast("string"), F.lit("p' "), shell_quoted(path))


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def classify_error(message: Column) -> Column:
    """The stable name of a failure; the first rule that fits."""
    low = F.lower(message)
    status = F.regexp_extract(low, r"worker http \s*(\d+)", 1)
    hundreds = F.floor(status.try_cast("bigint") / 100)
    by_status = F.when(hundreds == 4, "http_4xx").when(hundreds == 5, "http_5xx").otherwise("http_other")
    out = F.lit("other")
    for name, needles in reversed(FAILURES):
        if needles is None:
            out = F.when(status != "", by_status).otherwise(out)
        else:
            holds = low.contains(needles[0])
            for needle in needles[1:]:
                holds = holds | low.contains(needle)
            out = F.when(holds, name).otherwise(out)
    return out
