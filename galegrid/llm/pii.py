"""Personal data: patterns for protected entities, and terms that give entities away by corpus co-occurrence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, text_of
from .spans import holders, match_spans

#: The kinds in the contract's order. The patterns match what the contract's do; repeats are possessive, and
#: a match starts at the start of a run of its characters (or where the last match ended), so long runs cost linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}{3,}"
#: Terms that may be named in a broadcast (words of some 20 bytes), and bytes of documents with the terms they hold.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 20_000_000
#: Lengths summed at once when a word's place is worked out.
BLOCK = 512


@dataclass(frozen=True)
class Disclosure:
    """window: code points on both sides of an entity whose whole words count as together with it. min_support: documents, and
    different contexts, in which a term must stand by an entity before its estimate counts. generalise, remove: shares of the
    entity's information that a term may give away at most before it is generalised, or removed. assured: the share must
    be this at least even at the lower end of its confidence interval, of z standard errors."""

    window: int = 80
    min_support: int = 2
    generalise: float = 0.8
    remove: float = 0.95
    assured: float = 0.6
    z: float = 1.96


def valid(kind: Column, found: Column) -> Column:
    """The contract's conditions on a match."""
    parts = F.transform(F.split(found, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    ip = F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.char_length(digits)

    def doubled(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    luhn = F.aggregate(F.transform(F.split(F.reverse(F.substring(digits, 1, 19)), ""), doubled), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    card = n.between(12, 19) & (F.when(n.between(12, 19), luhn % 10) == 0)
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", card).otherwise(n.between(9, 15))


def entity_spans(docs: DataFrame, window: int = 0) -> DataFrame:
    """Base spans; before and after hold the whole words within window code points."""
    # one sign more than the window tells whether its outermost word is whole
    found = match_spans(docs, PATTERNS, window + 1 if window else 0).where(F.coalesce(valid(F.col("kind"), F.col("found")), F.lit(False)))
    before, after = F.col("before"), F.col("after")
    return found.withColumns({
        "before": F.when(F.char_length(before) > window, F.regexp_replace(before, r"^(?:\p{L}++|.)", "")).otherwise(before),
        "after": F.when(F.char_length(after) > window, F.regexp_replace(after, r"(?s)(?:(?<!\p{L})\p{L}++|.)\z", "")).otherwise(after),
    })


def entity_names(kind: Column, found: Column) -> Column:
    """What a span is an instance of: itself, and its class: an email's domain, an address's first three parts, a card's issuer (six
    digits), a number's country and area (five digits). A kind as a whole is no entity: nothing is disclosed by it."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    of = (
        F.when(kind == "email", F.lower(F.regexp_extract(found, "@(.*)$", 1))).when(kind == "ip", F.regexp_extract(found, r"^(.*)\.", 1))
        .when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    )
    return F.array(F.concat_ws(":", kind, found), F.concat_ws(":", F.lit("class"), kind, of))


def revealing_terms(docs: DataFrame, entities: DataFrame, s: Disclosure) -> tuple[DataFrame, DataFrame]:
    """(term, share, removed): terms near entities whose pointwise mutual information with one of them, or with its class, is at least
    the given share of that entity's information content; and (doc_id, rid, term) of the documents that hold one.

    With N documents, PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) and IC(e) = log2(N / n(e)): their ratio is 1 where each document
    with the term has the entity by it, and falls as the term is used elsewhere. n(t, e) / n(t) is also taken at the lower end of
    its Wilson interval, so that few documents prove something of a rare entity alone. Copied passages are one context, so that
    they prove nothing by themselves.
    """
    context = F.concat_ws(" ", "before", "after")
    named = entities.select("doc_id", "rid", F.explode(entity_names(F.col("kind"), F.col("found"))).alias("name"), context.alias("said"))
    near = named.select(
        "doc_id", "rid", F.xxhash64("name").alias("entity"), F.xxhash64("said").alias("context"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("said"), F.lit(TERM), F.lit(0)))).alias("term"),
    )
    n_e = named.select(F.xxhash64("name").alias("entity"), "doc_id", "rid").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n_near = near.select("term", "doc_id", "rid").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    total = docs.count()
    content = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))

    def share(chance: Column) -> Column:
        return F.when(content > 0, (content + F.log2(chance)) / F.when(content > 0, content)).otherwise(0.0)

    def assured(p: Column, n: Column) -> Column:
        z2 = s.z * s.z
        return (p + z2 / (2 * n) - s.z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)

    def reveals(n_t: Column) -> Column:
        p = F.least(F.col("n_te"), n_t) / n_t
        return (share(p) >= s.generalise) & (share(assured(p, n_t)) >= s.assured)

    # a term stands in n_near documents at least, so its share is no more than that number gives: common words go here, and
    # the pass over all words looks for few terms
    pairs = kept(
        near.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct(F.struct("doc_id", "rid")).alias("n_te"))
        .where((F.col("contexts") >= s.min_support) & (F.col("n_te") >= s.min_support)).join(n_e, "entity").join(n_near, "term")
        .where(share(F.least("n_te", "n_near") / F.col("n_near")) >= s.generalise)
    )
    holds = kept(holders(docs, pairs.select("term").distinct(), TERM))
    n_t = holds.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = F.greatest("df", "n_near")
    shares = pairs.join(n_t, "term").where(reveals(df)).withColumn("share", share(F.least("n_te", df) / df))
    terms = kept(shares.groupBy("term").agg(F.max("share").alias("share")).withColumn("removed", F.col("share") >= s.remove))
    return terms, holds


def term_spans(docs: DataFrame, terms: DataFrame, holds: DataFrame) -> DataFrame:
    """Spans of the terms wherever they stand as words, in the form of match_spans, with removed. holds: (doc_id, rid, term).

    Only documents that hold a term are read on, and only its places leave the row: a place is the sum of the lengths before it,
    taken from sums of BLOCK lengths and the rest of its block. Each explode of one struct keeps what is under it from being worked
    out anew for each word.
    """
    words = docs.select("doc_id", F.xxhash64(text_of()).alias("t_rid"), text_of().alias("text"))
    few = F.broadcast(terms) if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else terms
    wanted = kept(
        holds.join(few, "term").groupBy(F.col("doc_id").alias("w_doc"), F.col("rid").alias("w_rid"))
        .agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))
    )
    bytes_ = F.sum(F.octet_length(F.array_join("terms", ",")) + F.octet_length(F.array_join("gone", ",")) + 64)
    named = F.broadcast(wanted) if (wanted.agg(bytes_).first()[0] or 0) <= BROADCAST_BYTES else wanted
    match = words.doc_id.eqNullSafe(F.col("w_doc")) & (F.col("t_rid") == F.col("w_rid"))
    found, between = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    one = words.join(named, match).select(
        "doc_id", F.col("t_rid").alias("rid"), "terms", "gone",
        F.explode(F.array(F.struct(found.alias("found"), F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), found, lambda g, f: F.char_length(g) + F.char_length(f)).alias("steps")))).alias("x"),
    )

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("x.steps") - 1) / BLOCK).cast("int")), lambda b: total(F.slice("x.steps", b * BLOCK + 1, F.lit(BLOCK))))
    at = F.filter(F.sequence(F.lit(0), F.size("x.found") - 1), lambda i: F.array_contains("terms", F.lower(F.get("x.found", i))))
    two = one.select("doc_id", "rid", "gone", "x", F.explode(F.array(F.struct(blocks.alias("blocks"), at.alias("at")))).alias("y"))

    def place(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        end = total(F.slice("y.blocks", F.lit(1), block)) + total(F.slice("x.steps", block * BLOCK + 1, i - block * BLOCK + 1))
        return F.struct(end.cast("long").alias("end"), F.get("x.found", i).alias("found"))

    spans = two.select("doc_id", "rid", "gone", F.explode(F.transform("y.at", place)).alias("s")).select(
        "doc_id", "rid", F.lit("term").alias("kind"), (F.col("s.end") - F.char_length("s.found")).alias("start"), F.col("s.end").alias("end"), F.col("s.found").alias("found"),
        F.lit("").alias("before"), F.lit("").alias("after"), F.array_contains("gone", F.lower("s.found")).alias("removed"),
    )
    return spans.dropDuplicates(["doc_id", "rid", "start"])


def find_personal_data(docs: DataFrame, s: Disclosure = Disclosure()) -> DataFrame:
    """Spans of personal data: (doc_id, rid, kind, start, end, found, removed), kind one of KINDS; positions count code points.

    Emails, addresses, card and phone numbers by the contract's patterns, each kind by itself; and, as kind term, words that
    reveal such an entity (revealing_terms); removed is true for those over the higher threshold. All counts cover all
    documents. Null texts: no spans. Null doc_id: kept. Long texts are searched whole. Equal rows: their spans are given once. Empty table: no rows.
    Extra columns are left out.
    """
    entities = kept(entity_spans(docs, s.window))
    terms, holds = revealing_terms(docs, entities, s)
    base = entities.drop("before", "after").withColumn("removed", F.lit(False))
    if terms.isEmpty():
        return base
    return base.unionByName(term_spans(docs, terms, holds).drop("before", "after"))


def span_columns(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, rid, n_email, n_ip, n_card, n_phone, base, spans) for each row of docs; the last two: kind:start:end by start,
    then kind, joined by commas."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", order.alias("order"), "end", F.concat_ws(":", "kind", "start", "end").alias("said"))
    by_doc = spans.groupBy("doc_id", "rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PATTERNS], F.sort_array(F.collect_list(one)).alias("all")
    ).withColumnsRenamed({"doc_id": "s_doc", "rid": "s_rid"})
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("rid"))
    joined = rows.join(by_doc, rows.doc_id.eqNullSafe(F.col("s_doc")) & (rows.rid == F.col("s_rid")), "left")

    def said(xs: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(xs, lambda x: x["said"]), ","), F.lit(""))

    return joined.select(
        "doc_id", "rid", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in PATTERNS],
        said(F.filter("all", lambda x: x["order"] <= len(PATTERNS))).alias("base"), said(F.col("all")).alias("spans"),
    )


def sanitise(docs: DataFrame, s: Disclosure = Disclosure()) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets, or by nothing for removed terms. Of overlapping spans the
    first stands for all. Columns as docs has them. Null texts stay null, repeated rows stay, an empty table gives no rows."""
    spans = find_personal_data(docs, s)
    before = Window.partitionBy("doc_id", "rid").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    first = spans.withColumn("__covered", F.max("end").over(before)).where(F.col("__covered").isNull() | (F.col("start") >= F.col("__covered")))
    put = F.when(F.col("removed"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    by_doc = first.groupBy(F.col("doc_id").alias("__s_doc"), F.col("rid").alias("__s_rid")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", put.alias("put")))).alias("__spans")
    )
    rows = docs.withColumn("__rid", F.xxhash64(text_of()))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__s_doc")) & (F.col("__rid") == F.col("__s_rid")), "left")
    text, spans_ = F.col("text"), F.col("__spans")

    def piece(x: Column, i: Column) -> Column:
        since = F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(spans_, i - 1)["end"], F.lit(0)))
        return F.concat(F.substring(text, (since + 1).cast("int"), (x["start"] - since).cast("int")), x["put"])

    rest = F.substring(text, (F.element_at(spans_, -1)["end"] + 1).cast("int"), F.char_length(text))
    cleaned = F.when(spans_.isNull(), text).otherwise(F.concat(F.array_join(F.transform(spans_, piece), ""), rest))
    return joined.select(*[cleaned.alias(c) if c == "text" else F.col(c) for c in docs.columns])
