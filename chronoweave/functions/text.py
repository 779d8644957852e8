"""Names, shingles, sentences and prompt text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MIN_NAME_CHARS = 6
MIN_NAME_TOKENS = 2
MIN_ENTROPY_BITS = 1.5
SHINGLE_CHARS = 3
CANDIDATE_SUMMARY_CHARS = 120
MAX_SUMMARY_CHARS = 1000
GENERIC_LABEL = "Entity"


def _squeezed(x: Column) -> Column:
    # (?U): without it Java's \s misses the no-break and the ideographic space
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_exact(name: Column) -> Column:
    """Lower case, single spaces, no blanks at the ends."""
    return _squeezed(F.lower(name))


def normalize_fuzzy(name: Column) -> Column:
    """normalize_exact() with ASCII letters, digits, apostrophes and spaces only."""
    return _squeezed(F.regexp_replace(normalize_exact(name), "[^a-z0-9' ]", " "))


def name_entropy(normalized: Column) -> Column:
    """Shannon entropy in bits over the characters but spaces; 0 for none."""
    bare = F.replace(normalized, F.lit(" "), F.lit(""))
    chars, total = F.split(bare, ""), F.length(bare)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / total)
    return F.when(total > 0, -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))).otherwise(F.lit(0.0))


def has_high_entropy(normalized: Column) -> Column:
    """Whether a name tells enough for fuzzy matching."""
    tokens = F.size(F.filter(F.split(normalized, " "), lambda t: t != ""))
    short = (F.length(normalized) < MIN_NAME_CHARS) & (tokens < MIN_NAME_TOKENS)
    return ~short & (name_entropy(normalized) >= MIN_ENTROPY_BITS)


def shingles(normalized: Column) -> Column:
    """Sorted distinct 3-grams without spaces; one character is itself, two give none."""
    bare = F.replace(normalized, F.lit(" "), F.lit(""))
    n = F.length(bare)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE_CHARS - 1), F.lit(1))), lambda i: F.substring(bare, i, SHINGLE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(n >= SHINGLE_CHARS, F.array_sort(F.array_distinct(grams))).when(n == 1, F.array(bare)).otherwise(none)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets: 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def truncate_at_sentence(text: Column, most: int) -> Column:
    """At most `most` characters, up to the last sentence end among them if there is one."""
    head = F.left(text, F.lit(most))
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?](?:(?U:\s)|\z))", 1)
    cut = F.regexp_replace(F.when(whole != "", whole).otherwise(head), r"(?U)\s+\z", "")
    return F.when(F.length(text) <= most, text).otherwise(cut)


def sentence_end(text: Column) -> Column:
    """Place (from 0) of the first sentence end: a mark at the end or before a space and a capital; null if none."""
    at = F.regexp_instr(text, F.lit(r"[.!?](?=\z| \p{Lu})"))
    return F.when(at > 0, at - 1)


def brief_type_description(text: Column) -> Column:
    """The first paragraph on one line, three sentences at most."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    state = F.aggregate(  # lines of the first paragraph, and whether it has ended
        lines,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over")),
        lambda acc, x: F.struct(
            F.when(~acc["over"] & (x != ""), F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"),
            (acc["over"] | ((x == "") & (F.size(acc["kept"]) > 0))).alias("over"),
        ),
    )
    joined = F.array_join(state["kept"], " ")
    three = F.regexp_extract(joined, r"(?s)^(?:.*?[.!?](?=\z| \p{Lu})\s*){1,3}", 0)
    # fewer than three ends: all of it
    ends = F.size(F.regexp_extract_all(joined, F.lit(r"[.!?](?=\z| \p{Lu})"), F.lit(0)))
    return F.trim(F.when(ends >= 3, three).otherwise(joined))


def concatenate_episodes(contents: Column, times: Column) -> Column:
    """One text passes as it is; several get numbered headers with their times."""
    blocks = F.transform(
        F.arrays_zip(contents.alias("c"), times.alias("t")),
        lambda x, i: F.concat(F.lit("[Episode "), i.cast("string"), F.lit("] (timestamp: "), F.coalesce(x["t"], F.lit("unknown")), F.lit(")\n"), x["c"]),
    )
    return F.when(F.size(contents) == 1, F.get(contents, 0)).otherwise(F.array_join(blocks, "\n\n"))


def spaced_time(iso: Column) -> Column:
    """The first T of a time as a space."""
    return F.regexp_replace(iso, "^([^T]*)T", "$1 ")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def merged_summary(summary: Column, facts: Column) -> Column:
    """A summary with the non-empty facts (an array) on lines of their own; the summary itself without facts."""
    lines = F.array_join(F.filter(facts, lambda x: x != ""), "\n")
    merged = F.regexp_replace(F.concat(summary, F.lit("\n"), lines), r"(?U)^\s+|\s+\z", "")
    return F.when(F.coalesce(F.size(facts), F.lit(0)) > 0, merged).otherwise(summary)


def may_append(summary: Column) -> Column:
    """Whether a merged summary is kept without asking a model."""
    return (summary != "") & (F.length(summary) <= 2 * MAX_SUMMARY_CHARS)


def specific_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != GENERIC_LABEL)


def primary_label(labels: Column) -> Column:
    """The first label other than Entity, else Entity."""
    return F.coalesce(F.get(specific_labels(labels), 0), F.lit(GENERIC_LABEL))


def promoted_labels(existing: Column, drafted: Column) -> Column:
    """A generic node takes a draft's specific labels; a specific one keeps its own."""
    more = specific_labels(drafted)
    union = F.array_distinct(F.concat(F.array(F.lit(GENERIC_LABEL)), existing, more))
    return F.when((F.size(specific_labels(existing)) > 0) | (F.size(more) == 0), existing).otherwise(union)


def strip_fences(text: Column) -> Column:
    """A reply without the fence around it, tagged json or not."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    opened = F.regexp_replace(bare, r"^```(?:json)?", "")
    return F.regexp_replace(F.regexp_replace(opened, r"```\z", ""), r"(?U)^\s+|\s+\z", "")


def salvaged(json: Column, required: list[str]) -> Column:
    """A reply that echoes its schema has its fields under `properties`; takes those where the required ones are missing."""
    direct = F.lit(True)
    nested = F.lit(True)
    for key in required:
        direct = direct & F.get_json_object(json, f"$.{key}").isNotNull()
        nested = nested & F.get_json_object(json, f"$.properties.{key}").isNotNull()
    return F.when(~direct & nested, F.get_json_object(json, "$.properties")).otherwise(json)


def clamped_indices(indices: Column, n: Column) -> Column:
    """Indices in 0..n-1; all of these if none is left."""
    kept = F.filter(F.coalesce(indices, F.array(F.lit(0).cast("bigint"))), lambda i: (i >= 0) & (i < n))
    every = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def speakers(content: Column) -> Column:
    """Names before the colon of each line."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?m)^([^:\n]+):"), F.lit(1)))
