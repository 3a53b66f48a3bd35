"""PII with DataFrame functions only: patterns, and terms that give an entity away.

Base spans are found by pattern. A term that occurs together with a protected entity gives it
away if knowing the term tells most of what knowing the entity would: with document counts n
over a corpus of N documents, the term's pointwise mutual information
``log2(n(entity, term) * N / (n(entity) * n(term)))`` is compared with the information
content ``log2(N / n(entity))`` of the entity. Terms that reach ``threshold`` of it, on
``min_support`` documents at least, are disclosing: wherever they stand in a document that
holds the entity they become spans of kind ``term``. Entities are generalised to their kind,
terms are removed. Documents are whole texts, and repeated rows count as often as they come.

As a pair's documents are at most those of its entity, a term in more than
``n(entity) * (N / n(entity)) ** (1 - threshold)`` documents cannot reach the threshold; such
pairs are dropped before they are formed, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. Nothing inside a run of the first class can start a match that the
# run's beginning could not, so a match starts at the beginning of a run or where the last
# match ended (\G); that, and runs that give nothing back, keep the search linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]++"
_EDGES = ".,;:!?()[]{}<>\"'`|*#%&$^~_=+-/\\@"  # punctuation that is not part of a term
_NOT_DIGIT = "[^0-9]"


def _located(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their code point offsets: matches and what lies between them alternate."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")
    )

    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"),
            pair["value"].alias("value"),
        )
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        found,
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )
    return F.aggregate(pairs, start, add, lambda acc: acc["spans"])


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, _NOT_DIGIT, ""))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, place, 1).cast("int")
        twice = digit * 2
        even = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when(place % 2 == 0, even).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _is_ip(value: Column) -> Column:
    parts = F.split(value, r"\.")

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(parts, small)


def _holds(kind: str, value: Column) -> Column:
    n_digits = F.length(F.regexp_replace(value, _NOT_DIGIT, ""))
    if kind == "ip":
        return _is_ip(value)
    if kind == "card":
        # The order of tests matters: the sum runs over few digits only.
        return F.when(n_digits.between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return n_digits.between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda span: _holds(kind, span["value"])


def base_spans(text: Column) -> Column:
    """Base spans of a text by kind as listed, then start."""
    needs = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": text.contains("+"),
    }
    empty = F.array().cast(_SPANS)
    parts = []
    for kind in KINDS:
        spans = F.filter(_located(text, PATTERNS[kind], kind), _test(kind))
        parts.append(F.when(needs[kind], spans).otherwise(empty))
    return F.concat(*parts)


def term_of(word: Column) -> Column:
    """A word without punctuation at its ends, in lower case."""
    return F.lower(F.btrim(word, F.lit(_EDGES)))


def _located_terms(text: Column, terms: Column) -> Column:
    """The words of a text that are one of ``terms``, as spans, in order."""
    found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    between = F.split(text, _WORD, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        term = term_of(pair["value"])
        span = F.struct(
            F.lit("term").alias("kind"), begin.alias("start"), end.alias("end"), term.alias("value")
        )
        spans = F.when(
            F.array_contains(terms, term), F.concat(acc["spans"], F.array(span))
        ).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        found,
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )
    return F.aggregate(pairs, start, add, lambda acc: acc["spans"])


def _terms(text: Column) -> Column:
    """The different terms of a text that have a letter."""
    every = F.array_distinct(F.transform(F.split(text, _GAP), term_of))
    return F.filter(every, lambda t: t.rlike(r"\p{L}"))


def disclosing_terms(
    held: DataFrame, words: DataFrame, n_docs: int, threshold: float, min_support: int
) -> DataFrame:
    """``doc`` and its disclosing ``terms``.

    ``held`` has ``doc, times, entities, terms`` of each different document that holds an
    entity, ``words`` has ``term, n_term`` over all documents.
    """
    total = float(max(n_docs, 1))
    each = held.select("doc", "times", F.explode("entities").alias("entity"))
    sizes = each.groupBy("entity").agg(F.sum("times").alias("n_entity"))
    most = F.col("n_entity") * F.pow(F.lit(total) / F.col("n_entity"), F.lit(1.0 - threshold))
    live = each.join(sizes.filter(F.col("n_entity") >= min_support), "entity").withColumn(
        "limit", most * (1 + 1e-9)
    )
    live = stored(live, "entities")
    tops = live.groupBy("doc").agg(F.max("limit").alias("top"))
    mine = held.join(tops, "doc").select("doc", "top", F.explode("terms").alias("term"))
    rare = words.filter(F.col("n_term") >= min_support)
    mine = mine.join(rare, "term").filter(F.col("n_term") <= F.col("top"))
    mine = stored(mine.select("doc", "term", "n_term"), "rare-terms")
    pairs = mine.join(live, "doc").filter(F.col("n_term") <= F.col("limit"))
    counted = pairs.groupBy("entity", "term").agg(
        F.sum("times").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term")
    )
    shared = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    told = (content > 0) & (shared >= threshold * content) & (F.col("n_both") >= min_support)
    telling = counted.filter(told).select("entity", "term")
    hits = pairs.select("doc", "entity", "term").join(telling, ["entity", "term"])
    return hits.groupBy("doc").agg(F.collect_set("term").alias("terms"))


def find_pii(
    docs: DataFrame,
    text: str = "text",
    threshold: float = 0.8,
    min_support: int = 2,
) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive) and value.

    Base spans come first, by kind, then start; disclosing terms follow by start, but for words
    that touch a base span. Null and empty texts have none. Repeated rows count as documents of
    their own and get equal spans; a null key is a key. All columns stay, whatever their names;
    one named ``spans`` is replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() != "spans"]
    # The caller's row travels as one value, so that no name of its columns can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in kept])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        whole.alias("given"),
        F.md5(body).alias("doc"),  # equal texts are settled together and counted by their number
        body.alias("text"),
    ).withColumn("base", base_spans(F.col("text")))
    entities = F.array_distinct(
        F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), s["value"]))
    )
    holding = rows.filter(F.size("base") > 0)
    held = stored(
        holding.select("doc", entities.alias("entities"), _terms(F.col("text")).alias("terms"))
        .groupBy("doc")
        .agg(F.count("*").alias("times"), F.first("entities").alias("entities"), F.first("terms").alias("terms")),
        "held",
    )
    words = (
        rows.select(F.explode(F.array_distinct(F.transform(F.split("text", _GAP), term_of))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )
    found = stored(disclosing_terms(held, words, docs.count(), threshold, min_support), "disclosing")

    def bare(s: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    told = F.when(F.col("terms").isNotNull(), F.filter(_located_terms(F.col("text"), F.col("terms")), bare))
    none = F.array().cast(_SPANS)
    spans = F.concat("base", F.coalesce(told, none))
    # Only a text that holds an entity can have disclosing terms, so no other text moves.
    marked = holding.join(found, "doc", "left").select("given", spans.alias("spans"))
    plain = rows.filter(F.size("base") == 0).select("given", none.alias("spans"))
    return plain.unionByName(marked).select("given.*", "spans")


def sanitise(text: Column, spans: Column) -> Column:
    """The text with entities generalised to ``[KIND]`` and disclosing terms removed.

    Where spans overlap, the one that starts first (of these the longest) decides.
    """
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")
            ),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        end = -s["back"]
        mark = F.when(s["kind"] == "term", "").otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        )
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out")
        )).otherwise(
            F.struct(end.alias("at"), F.concat(acc["out"], gap, mark).alias("out"))
        )

    cleaned = F.aggregate(
        ordered,
        start,
        add,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, cleaned).otherwise(text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def span_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, a hash of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [
        F.size(F.filter("spans", _is_kind(k))).cast("bigint").alias(f"n_{k}")
        for k in (*KINDS, "term")
    ]
    return found.select(
        key,
        *counts,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
