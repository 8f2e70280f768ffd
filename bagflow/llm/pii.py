"""Personal data by patterns, and terms that reveal it by corpus co-occurrence (information-theoretic sanitisation).

Patterns find the protected entities: e-mail addresses, IP addresses, card numbers and phone numbers. Each mention counts
for its value and for the classes that the value belongs to: its kind, and the e-mail's domain, the address's first two
parts, the card's issuer (six digits) or the phone's country and area (first four digits). A term is any word of a text
that isn't part of a mention. With N documents, n(e) that hold the entity or class, n(t) that hold the term and n(t, e)
that hold both, anywhere in the text,

    P(e) = n(e) / N,   P(e | t) = (n(t, e) + smoothing * P(e)) / (n(t) + smoothing)

estimate what is known without and with the term, and the term discloses log2(P(e | t) / P(e)) bits of the
-log2 P(e) bits of information. A term exceeds the threshold if it leaves at most `residual` bits of them, discloses at
least `least_bits`, and stands with e in at least `support` different texts. Smoothing keeps the few documents of a rare
term from counting as proof: with the default 2, one common document leaves 1.6 bits, three leave 0.74. Such terms become
spans of kind "term" wherever they stand, in any document, and are generalised together with the entities when a text is
sanitised.

Everything is DataFrame functions; there is no Python on executors. Only terms that can exceed reach a join with
entities: n(t, e) is at most the number of documents with any mention that hold t, so terms for which that is too small
beside n(t) go first, as do entities in fewer than `support` texts. Counts are aggregated in tasks before they are
shuffled, and tables are broadcast only after their rows and bytes are checked.

Patterns are written with possessive quantifiers where giving back can't help, so that very long runs of matching
characters neither overflow the stack nor take quadratic time; they match what the plain forms match.

Defined results: null or empty text has no spans; repeated rows have equal spans; a null doc_id is treated as one more
document id; an empty table gives an empty result; overlapping spans of different kinds are all reported, and a
sanitised text replaces each stretch once, under the name of the span that begins first (ties: by order of kinds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, small, written

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the four kinds, by kind.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<rank:int,kind:string,start:int,end:int,value:string>>"
WHITE = r"[\x20\x09-\x0D]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _placed(text: Column, found: Column, pattern: Column, rank: int, kind: str) -> Column:
    """Spans of the matches `found`: split() gives what lies between them, so lengths give their places.

    The text is split once, in the argument of zip_with: inside a lambda it would be split again for every match.
    """
    each = F.zip_with(F.split(text, pattern, -1), found, lambda gap, v: F.struct(F.coalesce(F.length(gap), F.lit(0)).alias("gap"), v.alias("v")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(done: Column, e: Column) -> Column:
        start = done["at"] + e["gap"]
        end = start + F.length(e["v"])
        span = F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), e["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    spans = F.aggregate(F.filter(each, lambda e: e["v"].isNotNull()), begin, step, lambda done: done["out"])
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text: str = "text", name: str = "base") -> DataFrame:
    """docs with a column `name`: valid spans of all kinds by kind, then start."""
    columns = docs.columns
    found = {k: f"{name}_{k}_found" for k in KINDS}
    matches = {}
    for k in KINDS:
        m = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0))
        hint = F.contains(F.col(text), F.lit(HINTS[k])) if k in HINTS else F.col(text).rlike("[0-9]")
        matches[found[k]] = F.when(hint, m).otherwise(F.array().cast("array<string>"))
    out = docs.select(*columns, *[c.alias(n) for n, c in matches.items()])

    def spans_of(rank: int, k: str) -> Column:
        return F.filter(_placed(F.col(text), F.col(found[k]), F.lit(PATTERNS[k]), rank, k), lambda s: _valid(k, s["value"]))

    spans = [spans_of(rank, k) for rank, k in enumerate(KINDS)]
    return out.select(*columns, F.concat(*spans).alias(name))


def _entities(s: Column) -> Column:
    """The names of a span's value and classes."""
    value, kind = s["value"], s["kind"]
    digits = _digits(value)
    group = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, 1, 4))
    )
    return F.array(kind, F.concat_ws(" ", kind, F.lit("in"), group), F.concat_ws(" ", kind, F.lit("is"), value))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    """Distinct words, A-Z lowered."""
    return F.array_distinct(F.split(_lower(text), WHITE + "+"))


def _replaced(text: Column, spans: Column, by: Column | None = None) -> Column:
    """The text with each span (sorted by start) replaced by the name of its kind in brackets, or by `by`."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        name = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")) if by is None else by
        piece = F.concat(done["out"], F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), F.when(s["start"] >= done["at"], name).otherwise(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), piece.alias("out"))

    return F.aggregate(spans, begin, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def _in_order(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _survey(docs: DataFrame) -> DataFrame:
    """Written: doc_id, text_hash and base spans of every row, with the entities and other words of those that have spans."""
    spans = with_spans(docs.select("doc_id", "text"))
    some = F.size("base") > 0
    entities = F.array_distinct(F.flatten(F.transform("base", _entities)))
    words = F.filter(_words(_replaced(F.col("text"), _in_order(F.col("base")), F.lit(" "))), lambda w: w.rlike(r"[\p{L}\p{N}]{3}"))
    out = spans.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", F.when(some, entities).alias("entities"), F.when(some, words).alias("words"))
    return written(out, "pii-survey", codec="zstd")


def disclosing_terms(docs: DataFrame, found: DataFrame, *, residual: float = 0.75, least_bits: float = 2.0, support: int = 3, smoothing: float = 2.0) -> DataFrame:
    """(entity, term, n_both, n_term, n_entity, left, disclosed) over the whole corpus, written. found: see _survey."""
    total = float(max(found.count(), 1))
    # copies of a text are one row from here on
    holders = found.filter(F.size("base") > 0).groupBy("text_hash").agg(F.first("entities").alias("entities"), F.first("words").alias("words"), F.count("*").alias("n"))
    holders = written(holders, "pii-holders", codec="zstd")
    # the least share of a term's documents that any entity must have, with all smoothing in its favour
    share = 2.0**-residual
    known = holders.select("n", F.explode("words").alias("term")).groupBy("term").agg(F.sum("n").alias("n_held"))
    # a term in fewer than `support` documents with mentions can't stand with an entity in so many texts
    known = written(known.filter(F.col("n_held") >= support).select("term", "n_held"), "pii-known")
    terms = docs.select(F.explode(_words(F.col("text"))).alias("term")).join(small(known.select("term"), 1_000_000), "term", "left_semi")
    terms = terms.groupBy("term").agg(F.count("*").alias("n_term")).join(known, "term")
    terms = terms.filter(F.col("n_held") + smoothing >= share * (F.col("n_term") + smoothing))
    terms = small(written(terms.select("term", "n_term"), "pii-candidates"))
    often = holders.select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    often = small(written(often.select("entity", "n_entity"), "pii-entities"))
    # of each text only the candidates and the entities of enough texts are paired
    left = holders.select("text_hash", "n", F.explode("words").alias("term")).join(terms, "term")
    left = left.groupBy("text_hash", "n").agg(F.collect_list(F.struct("term", "n_term")).alias("terms"))
    right = holders.select("text_hash", F.explode("entities").alias("entity")).join(often, "entity")
    right = right.groupBy("text_hash").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    both = left.join(right, "text_hash").select("n", F.explode("terms").alias("t"), "entities").select("n", "t", F.explode("entities").alias("e"))
    both = both.groupBy("e.entity", "t.term", "t.n_term", "e.n_entity").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    prior = F.col("n_entity") / F.lit(total)
    after = (F.col("n_both") + smoothing * prior) / (F.col("n_term") + smoothing)
    out = both.withColumn("left", -F.log2(after)).withColumn("disclosed", F.log2(after / prior))
    out = out.filter((F.col("left") <= residual) & (F.col("disclosed") >= least_bits))
    return written(out.select("entity", "term", "n_both", "n_term", "n_entity", "left", "disclosed"), "pii-terms")


def _term_pattern(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Written, for the documents that hold disclosing terms: doc_id, text_hash and a pattern of the terms they hold."""
    terms = small(written(terms.select("term").distinct(), "pii-disclosing"), 1_000_000)
    # hashed before the words are dealt out: else every word would carry its text and hash it again
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_hash", F.explode("words").alias("term")).join(terms, "term", "left_semi")
    rows = rows.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    quoted = F.transform("terms", lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?i)(?<![^\x20\x09-\x0D])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![^\x20\x09-\x0D])"))
    return written(rows.select("doc_id", "text_hash", pattern.alias("pattern")), "pii-patterns")


def _term_spans(text: Column, pattern: Column) -> Column:
    return _placed(text, F.regexp_extract_all(text, pattern, F.lit(0)), pattern, len(KINDS), "term")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, n_term and all spans as a string, for every row. Options: see disclosing_terms."""
    docs = id_and_text(docs, id_col, text_col)
    found = _survey(docs)
    some = small(_term_pattern(docs, disclosing_terms(docs, found, **options)))
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    both = texts["doc_id"].eqNullSafe(some["doc_id"]) & (texts["text_hash"] == some["text_hash"])
    extra = texts.join(some, both).select(texts["doc_id"], texts["text_hash"], _term_spans(F.col("text"), F.col("pattern")).alias("extra"))
    extra = small(written(extra.dropDuplicates(["doc_id", "text_hash"]), "pii-extra"))
    base = found.select("doc_id", "text_hash", "base")
    out = base.join(extra, base["doc_id"].eqNullSafe(extra["doc_id"]) & (base["text_hash"] == extra["text_hash"]), "left")
    out = out.select(base["doc_id"], "base", F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with entities and disclosing terms of the text replaced by the name of their kind in brackets; null stays null."""
    columns = docs.columns
    plain = id_and_text(docs, id_col, text_col)
    found = _survey(plain)
    patterns = _term_pattern(plain, disclosing_terms(plain, found, **options)).withColumn("base", F.array().cast(SPAN))
    # only documents with spans change: those of the survey are reused, so no text is searched twice
    dirty = found.filter(F.size("base") > 0).select("doc_id", "text_hash", F.lit(None).cast("string").alias("pattern"), "base").unionByName(patterns)
    dirty = dirty.groupBy(F.col("doc_id").alias("dirty_id"), F.col("text_hash").alias("dirty_hash")).agg(F.max("pattern").alias("pattern"), F.max_by("base", F.size("base")).alias("base"))
    dirty = small(written(dirty, "pii-dirty"))
    # all columns of docs are in one struct, so that none has the name of a column here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    given = F.col("row").getField(text_col)
    rows = rows.withColumn("plain", F.coalesce(given, F.lit("")))
    rows = rows.join(dirty, F.col("row").getField(id_col).eqNullSafe(F.col("dirty_id")) & (F.xxhash64("plain") == F.col("dirty_hash")), "left")
    rows = rows.withColumn("base", F.coalesce("base", F.array().cast(SPAN)))
    extra = F.when(F.col("pattern").isNotNull(), _term_spans(F.col("plain"), F.col("pattern"))).otherwise(F.array().cast(SPAN))
    rows = rows.withColumn("spans", _in_order(F.concat("base", extra)))
    clean = F.when((F.size("spans") > 0) & given.isNotNull(), _replaced(F.col("plain"), F.col("spans"))).otherwise(given)
    return rows.select(*[(clean if c == text_col else F.col("row").getField(c)).alias(c) for c in columns])
