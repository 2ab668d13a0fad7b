"""Scalar functions on text: built-in column expressions but for MinHash."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark-up grammars. References exclude colons; time marks have raw and resolved parts.
REF = r"\[([^\[\]:]+)\]"
ALIAS_REF = r"\[([^\]:#]+)\]"
TIME_MARK = r"\[([^\[\]]+?)::([^\[\]]+)\]"
RENDER_MARK = r"\[([^\[\]:]+)::([^\[\]]+)\]"


def bracket_refs(text: Column) -> Column:
    """Distinct `[Name]` references in order of appearance; null gives null."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REF), F.lit(1)))


def time_marks(text: Column) -> Column:
    """array<struct<raw, resolved>> of the `[raw::resolved]` marks."""
    raw = F.regexp_extract_all(text, F.lit(TIME_MARK), F.lit(1))
    resolved = F.regexp_extract_all(text, F.lit(TIME_MARK), F.lit(2))
    return F.arrays_zip(raw.alias("raw"), resolved.alias("resolved"))


def search_text(text: Column, canonical: Column) -> Column:
    """Marks become their raw part, `[N]` becomes N, and ` [c1, c2]` is appended for the names in canonical, if any."""
    plain = F.regexp_replace(F.regexp_replace(text, TIME_MARK, "$1"), REF, "$1")
    return F.when(F.size(canonical) > 0, F.concat(plain, F.lit(" ["), F.array_join(canonical, ", "), F.lit("]"))).otherwise(plain)


def resolve_aliases(text: Column, pairs: Column) -> Column:
    """text with each `[alias]` replaced by `[canonical]`; pairs is array<struct<alias, canonical>>, folded in order."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, F.concat(F.lit("["), p["alias"], F.lit("]")), F.concat(F.lit("["), p["canonical"], F.lit("]"))))


def render_marks(text: Column) -> Column:
    """`[raw::resolved]` to `raw (resolved)`; raw may hold no colon."""
    return F.regexp_replace(text, RENDER_MARK, "$1 ($2)")


def inline_dates(text: Column) -> Column:
    """`[raw::resolved]` to `[resolved]`."""
    return F.regexp_replace(text, TIME_MARK, "[$2]")


def time_info(raw: Column, resolved: Column, fact_ts: Column) -> Column:
    """`raw [start]` or `raw [start, end]`, the resolved part being cut at its first slash; without a mark `[fact_ts]`, or empty."""
    start, end = F.substring_index(resolved, "/", 1), F.regexp_extract(resolved, "/(.*)$", 1)
    span = F.when(resolved.contains("/"), F.concat(start, F.lit(", "), end)).otherwise(resolved)
    known = F.concat(raw, F.lit(" ["), span, F.lit("]"))
    return F.when(resolved.isNotNull(), known).when(fact_ts.isNotNull() & (fact_ts != ""), F.concat(F.lit("["), fact_ts, F.lit("]"))).otherwise("")


def clean_time_info(info: Column) -> Column:
    """The dates in the first brackets, cut at T and joined by a slash; the text itself if there are none."""
    inside = F.regexp_extract(info, r"\[([^\]]*)\]", 1)
    days = F.filter(F.transform(F.split(inside, ","), lambda x: F.substring_index(F.trim(x), "T", 1)), lambda x: x != "")
    return F.when(F.size(days) > 0, F.array_join(days, "/")).otherwise(info)


def fact_line(text: Column, info: Column) -> Column:
    """`- text`, with ` (known from message on D)` if there is a time and none stands in the text."""
    known = F.concat(F.lit(" (known from message on "), clean_time_info(info), F.lit(")"))
    return F.concat(F.lit("- "), inline_dates(text), F.when((info != "") & ~text.rlike(TIME_MARK), known).otherwise(""))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long") + 1


def word_count(text: Column) -> Column:
    """White-space tokens; the default counter of tokens where no vocabulary is at hand."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


#: Fixed value: characters with a meaning in boolean full-text queries.
SPECIALS = r"[+\-&|!(){}\[\]^\"~*?:\\/`<>=]"


def sanitized_query(query: Column) -> Column:
    """Only ASCII, no query operators, single spaces; a query of other scripts becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(query, r"[^\x00-\x7F]", ""), SPECIALS, " "), r"\s+", " "))


def sanitized_boolean_query(query: Column) -> Column:
    """As sanitized_query, but keeps + - ( )."""
    kept = F.regexp_replace(query, r"[&|!{}\[\]^\"~*?:\\/`<>=]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalized_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def fuzzy_name(name: Column) -> Column:
    """Lower case, only a-z, 0-9, apostrophe and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalized_name(name), r"[^a-z0-9' ]", " "), r"\s+", " "))


def shingles(name: Column) -> Column:
    """Distinct three-letter shingles of the name without spaces; one shingle for shorter names, none for empty ones."""
    s = F.replace(name, F.lit(" "), F.lit(""))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < 3, F.array(s)).otherwise(grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 1 for two empty arrays, 0 if one is empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(both == 0, 1).otherwise(both))


def shingle_hash(shingle: Column, seed: Column | int) -> Column:
    """60 bits of the digest of `seed:shingle`; any engine with md5 gives the same."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), shingle))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


@lru_cache(maxsize=1 << 16)
def _hashes(shingle: str, seeds: int) -> tuple[int, ...]:
    return tuple(int(hashlib.md5(f"{s}:{shingle}".encode()).hexdigest()[:15], 16) for s in range(seeds))


def minhash_signature(grams: Column, seeds: int = 32) -> Column:
    """Least shingle_hash for each seed from 0; null entries for no shingles. In Arrow batches, each shingle hashed once a worker."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[min(h) for h in zip(*(_hashes(g, seeds) for g in own))] if own is not None and len(own) else [None] * seeds for own in batch])

    return F.pandas_udf(run, "array<long>")(grams)


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters without spaces, in bits; 0 for none."""
    chars = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.when(n == 0, 1).otherwise(n)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def session_label(raw: Column) -> Column:
    """The raw time if it has a clock after its eighth character, else its first ten characters."""
    t = F.trim(raw)
    return F.when((F.length(t) > 10) & F.substring(t, 9, 1000).rlike(r"\d{1,2}:\d{2}"), t).otherwise(F.substring(t, 1, 10))


def message_line(time: Column, speaker: Column, content: Column) -> Column:
    """`[time] speaker: content`, leaving out what is null or empty."""
    at = F.when(F.coalesce(time, F.lit("")) != "", F.concat(F.lit("["), time, F.lit("] "))).otherwise("")
    who = F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise("")
    return F.concat(at, who, F.coalesce(content, F.lit("")))


def known_entity_line(name: Column, aliases: Column, desc: Column) -> Column:
    also = F.when(F.size(aliases) > 0, F.concat(F.lit("also known as: "), F.array_join(aliases, ", ")))
    about = F.when(F.coalesce(F.trim(desc), F.lit("")) != "", F.concat(F.lit("desc: "), desc))
    return F.concat(F.lit("- "), F.concat_ws(" | ", name, also, about))


def shortened_reply(content: Column, keep: int = 400) -> Column:
    """Runs of empty lines closed up; of longer texts the last keep characters behind a mark."""
    flat = F.regexp_replace(content, r"\n{2,}", "\n")
    return F.when(F.length(flat) > keep, F.concat(F.lit("（……）"), F.substring(flat, -keep, keep))).otherwise(flat)


def shortened_question(content: Column, keep: int = 2000) -> Column:
    return F.substring(content, 1, keep)


def evidence_ref(ref: Column) -> Column:
    """`D1:3` to `S1:2`; null for other forms."""
    session, turn = F.regexp_extract(ref, r"^D(\d+):(\d+)$", 1), F.regexp_extract(ref, r"^D(\d+):(\d+)$", 2)
    return F.when(session != "", F.concat(F.lit("S"), session, F.lit(":"), (turn.try_cast("int") - 1).cast("string")))


def diary_content(fields: Column) -> Column:
    """`[k: v]` of a map<string,string>, without id, timestamp, category and nulls; `(empty)` if nothing is left."""
    kept = F.map_filter(fields, lambda k, v: ~k.isin("id", "timestamp", "category") & v.isNotNull())
    lines = F.transform(F.map_entries(kept), lambda e: F.concat(F.lit("["), e["key"], F.lit(": "), e["value"], F.lit("]")))
    return F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise("(empty)")


def ranked_answer(events: Column) -> Column:
    """Numbered lines of an array of events."""
    return F.array_join(F.transform(events, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e)), "\n")


def category_of(name: Column) -> Column:
    return F.regexp_replace(name, r"_questions?$", "")


def shuffled(options: Column, seed: Column) -> Column:
    """Options in an order fixed by seed: by the digest of seed and option."""
    return F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat(seed.cast("string"), F.lit("|"), o)).alias("k"), o.alias("o")))), lambda s: s["o"])


def persona_name(doc: Column) -> Column:
    """The name in a persona's JSON, wherever of the usual places it stands; `User` without one."""
    places = ("$.name", "$.full_name", "$.persona.name", "$.profile.name", "$.basic_info.name")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(doc, p)), F.lit("")) for p in places], F.lit("User"))


def judge_label(reply: Column) -> Column:
    """CORRECT or WRONG from a fenced JSON, an object with a label, or the bare word; null otherwise."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(reply, r"(?s)(\{[^{}]*\"label\"[^{}]*\})", 1), F.lit(""))
    word = F.upper(F.trim(F.coalesce(F.get_json_object(F.coalesce(fenced, bare), "$.label"), reply)))
    return F.when(word.isin("CORRECT", "WRONG"), word)


def final_answer(reply: Column) -> Column:
    """What follows the last FINAL ANSWER heading, or the whole reply."""
    tail = F.trim(F.regexp_extract(reply, r"(?is).*final answer\s*[:#*\n]*\s*(.+)$", 1))
    return F.when(tail != "", tail).otherwise(F.trim(reply))


def sections(text: Column) -> Column:
    """map of `[Heading]` lines to the text under each."""
    parts = F.filter(F.split(text, r"(?m)^\["), lambda p: F.trim(p) != "")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, "]", 1), F.trim(F.regexp_extract(p, r"(?s)\](.*)$", 1)))))


def chunk_prefix(file_name: Column, index: Column, total: Column, page: Column, content: Column) -> Column:
    """File, type, place, page and first heading of a chunk, joined by bars."""
    suffix = F.upper(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))
    heading = F.trim(F.regexp_extract(content, r"(?m)^#{1,6}\s+(.+)$", 1))
    return F.concat_ws(
        " | ", F.concat(F.lit("File: "), file_name), F.when(suffix != "", F.concat(F.lit("Type: "), suffix)), F.concat(F.lit("Part "), (index + 1).cast("string"), F.lit("/"), total.cast("string")),
        F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))), F.when(heading != "", F.concat(F.lit("Section: "), heading)),
    )


def is_sha256(digest: Column) -> Column:
    return F.coalesce(digest.rlike("^[0-9a-f]{64}$"), F.lit(False))


def escaped(text: Column) -> Column:
    """Escaped for markup, the ampersand first."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def without_nul(text: Column) -> Column:
    return F.trim(F.translate(text, "\x00", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8))


def lock_slot(key: Column) -> Column:
    """CRC-32 as a signed 32-bit integer."""
    c = F.crc32(key.cast("binary"))
    return F.when(c >= 2**31, c - 2**32).otherwise(c).cast("int")


def owner_of(name: Column) -> Column:
    """The owner in `Avery's badge`; empty without one."""
    return F.trim(F.regexp_extract(name, r"^(.+?)['’]s\s+\S", 1))


def is_titlecase(name: Column) -> Column:
    """One to four words, in each of which capitals begin a part and small letters go on: it looks like a person."""
    w = F.filter(F.split(name, r"\s+"), lambda x: x != "")
    return (F.size(w) > 0) & (F.size(w) <= 4) & F.forall(w, lambda x: x.rlike(r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$"))


def identity_conflict(new: Column, target: Column, aliases: Column | None = None, desc: Column | None = None) -> Column:
    """True if a new name cannot denote the target: it names another owner than all that the target's names and description name, or a person where the target
    is somebody's thing or has no name of a person."""
    names = F.array(target) if aliases is None else F.array_distinct(F.concat(F.array(target), F.coalesce(aliases, F.array().cast("array<string>"))))
    names = F.filter(names, lambda n: n.isNotNull())
    owners = F.filter(F.transform(names, owner_of), lambda o: o != "")
    if desc is not None:
        owners = F.concat(owners, F.regexp_extract_all(F.coalesce(desc, F.lit("")), F.lit(r"\b([A-Z][\w-]*(?:\s+[A-Z][\w-]*)*)['’]s\b"), F.lit(1)))
    owners = F.transform(owners, normalized_name)
    own = owner_of(new)
    other_owner = (own != "") & (F.size(owners) > 0) & ~F.array_contains(owners, normalized_name(own))
    person = (own == "") & is_titlecase(new)
    has_person = F.exists(names, lambda n: (owner_of(n) == "") & is_titlecase(n))
    return F.coalesce(other_owner | (person & ((F.size(owners) > 0) | ~has_person)), F.lit(False))


def aspect_text(entity: Column, desc: Column, path: Column, text: Column, info: Column) -> Column:
    """`[Entity (desc) > path] text (date: t)` as a text to rank by."""
    head = F.concat(F.lit("["), entity, F.when(F.coalesce(desc, F.lit("")) != "", F.concat(F.lit(" ("), desc, F.lit(")"))).otherwise(""), F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(" > "), path)).otherwise(""), F.lit("] "))
    return F.concat(head, text, F.when(F.coalesce(info, F.lit("")) != "", F.concat(F.lit(" (date: "), info, F.lit(")"))).otherwise(""))


def highlighted(text: Column, needle: str) -> Column:
    """Each occurrence of needle, in any case, inside mark tags."""
    import re

    return text if not needle else F.regexp_replace(text, f"(?i)({re.escape(needle)})", "<mark>$1</mark>")


def title_of(content: Column, keep: int = 50) -> Column:
    return F.when(F.length(content) > keep, F.concat(F.substring(content, 1, keep), F.lit("..."))).otherwise(content)


def clock_time(raw: Column) -> Column:
    """Timestamp of the three forms that evaluation sets use; null for others."""
    bare = F.trim(F.regexp_replace(raw, r"\s*\([A-Za-z]{3}\)", ""))
    return F.coalesce(F.try_to_timestamp(F.upper(bare), F.lit("h:mm a 'ON' d MMMM, yyyy")), F.try_to_timestamp(bare, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(F.replace(bare, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")))
