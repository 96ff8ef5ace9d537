"""Information-theoretic sanitisation (operator 1; DataFrame and SQL functions only).

*Base spans.*  One pass over the whole texts finds e-mail addresses, IP numbers,
card numbers and phone numbers.  ``split`` gives the gaps between matches, so a
match's place is the running length before it; only matches leave the scan.

*Protected entities* are the values found.  *Terms* are the words of the documents
that hold one, wherever they stand.  Over all N documents, with df the documents that
hold a term or an entity and co those that hold both,

    disclosure(term, entity) = log2(co * N / (df(term) * df(entity))) / log2(N / df(entity))

is the share of the entity's information that the term reveals (pointwise mutual
information over information content).  In a document with the entity, every occurrence
of a term at or over ``REMOVE`` is removed and of one at or over ``GENERALISE`` replaced
by a class; a disclosure needs ``SUPPORT`` documents.  Documents without a protected
entity stay as they are.

As co <= df(entity), a term of a share of at least s has df(term) <=
N ** (1 - s) * df(entity) ** s: frequent words go before terms and entities are paired,
which loses no term.  Counts are aggregated before each shuffle.

Defined results: a null text is empty; repeated rows each get their row; nulls in
``doc_id`` stay; an empty table gives no rows; an entity in every document has no
information to reveal, so nothing beside it is a disclosure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, keyed
from .registry import register

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE = KINDS[:4]
SUPPORT, GENERALISE, REMOVE = 2, 0.6, 0.9

#: The contract's patterns, written so that no start inside a run is tried twice and
#: no repetition recurses: a match starts where its run starts, or where the match
#: before it ended.  A card is a maximal run of 14 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"


def _pieces(kind: str, text: Column) -> Column:
    """Matches of a kind with the length of the gap before each; the last piece has no
    match, only the gap behind the last one."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pieces = F.transform(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["hit"].alias("hit"),
        F.length(x["gap"]).cast("bigint").alias("gap")))
    none = F.array().cast("array<struct<kind:int,i:int,hit:string,gap:bigint>>")
    return F.when(text.rlike(HINTS[kind]), F.filter(pieces, lambda p: p["hit"].isNotNull() | (p["i"] > 0))
                  ).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return (F.when(kind == KINDS.index("email"), F.lit(True))
            .when(kind == KINDS.index("ip"), F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (
                F.substring(part(p), 1, 3).cast("int") <= 255)))
            .when(kind == KINDS.index("card"), luhn(digits))
            .otherwise(F.length(digits).between(10, 15)))


def base_spans(docs: DataFrame) -> DataFrame:
    """``rid, kind, start, end, hit`` of every base span; kind is its place in ``KINDS``."""
    text = F.col("text")
    found = docs.where(text.isNotNull()).select(
        "rid", F.explode(F.concat(*[_pieces(k, text) for k in BASE])).alias("p")).select("rid", "p.*")
    each = Window.partitionBy("rid", "kind").orderBy("i")
    placed = found.select(
        "rid", "kind", "hit", F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(
            each.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    return (placed.where(F.col("hit").isNotNull()).where(_passes(F.col("kind"), F.col("hit")))
            .select("rid", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit"))


def candidates(docs: DataFrame) -> DataFrame:
    """The documents that have a match of any kind: all that have a base span are among them."""
    any_kind = F.lit(False)
    for kind in BASE:
        any_kind = any_kind | (F.col("text").rlike(HINTS[kind]) & F.col("text").rlike(PATTERNS[kind]))
    return docs.where(any_kind)


def words(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def held_entities(spans: DataFrame, n: int, support: int) -> DataFrame:
    """``rid, entity, df_entity`` of the entities that can have a disclosure."""
    held = spans.select("rid", F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "hit"
                                           ).alias("entity")).distinct()
    df = held.groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    return held.join(df.where((F.col("df_entity") >= support) & (F.col("df_entity") < n)), "entity")


def held_terms(docs: DataFrame, held: DataFrame, n: int, support: int, low: float) -> DataFrame:
    """``rid, term, df_term`` of the words of the documents with an entity, without
    words too rare or too frequent for a disclosure of any entity."""
    most = held.agg(F.max("df_entity")).first()[0] or 0
    term_df = docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    telling = term_df.where((F.col("df_term") >= support) & (F.col("df_term") <= _most_frequent(F.lit(most), n, low)))
    texts = candidates(docs).select("rid", words(F.col("text")).alias("words")).join(
        held.select("rid").distinct(), "rid", "left_semi")
    return texts.select("rid", F.explode("words").alias("term")).join(telling, "term").select("rid", "term", "df_term")


def _most_frequent(df_entity: Column, n: int, low: float) -> Column:
    """The largest df of a term that can reveal ``low`` of an entity (a little over, for rounding)."""
    return F.pow(F.lit(float(max(n, 1))), F.lit(1 - low)) * F.pow(df_entity.cast("double"), F.lit(float(low))) * 1.000001


def beside(held: DataFrame, terms: DataFrame, n: int, low: float) -> DataFrame:
    """``rid, entity, term, df_entity, df_term`` of the pairs that a document holds."""
    return held.join(terms, "rid").where(F.col("df_term") <= _most_frequent(F.col("df_entity"), n, low))


def disclosures(pairs: DataFrame, n: int, support: int = SUPPORT, low: float = GENERALISE) -> DataFrame:
    """``entity, term, share`` of the terms beside an entity that reveal at least ``low``."""
    together = pairs.groupBy("entity", "term", "df_entity", "df_term").agg(
        F.count(F.lit(1)).alias("together")).where(F.col("together") >= support)
    mutual = F.log2(F.col("together") * F.lit(float(n)) / (F.col("df_term") * F.col("df_entity")))
    whole = F.log2(F.lit(float(n)) / F.col("df_entity"))
    return together.select("entity", "term", (mutual / whole).alias("share")).where(F.col("share") >= low)


def _places(text: Column, shares: Column) -> Column:
    """Occurrences of the words that ``shares`` has, with their share."""
    cells = F.arrays_zip(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("w"), F.split(text, TERM, -1).alias("g"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint,share:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["w"]), F.lit(0))
        share = F.try_element_at(shares, F.lower(x["w"]))
        place = F.struct(start.alias("start"), end.alias("end"), share.alias("share"))
        return F.struct(end.alias("at"), F.when(share.isNull(), acc["out"]).otherwise(
            F.concat(acc["out"], F.array(place))).alias("out"))

    return F.aggregate(cells, empty, step)["out"]


def occurrences(docs: DataFrame, pairs: DataFrame, telling: DataFrame) -> DataFrame:
    """``rid, start, end, share`` of every occurrence of a term in the documents that
    hold an entity that it reveals."""
    shares = pairs.join(telling, ["entity", "term"]).groupBy("rid", "term").agg(F.max("share").alias("share"))
    of_row = shares.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    found = candidates(docs).select("rid", "text").join(of_row, "rid").select(
        "rid", F.explode(_places(F.col("text"), F.col("shares"))).alias("p"))
    return found.select("rid", "p.*")


def find_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE,
               remove: float = REMOVE) -> DataFrame:
    """``rid, doc_id, spans`` of every row of ``docs`` (``rid, doc_id, text``): spans
    are structs start, kind, end in the order of start and kind."""
    spans = materialize(base_spans(docs), "spans")
    n = docs.count()
    held = materialize(held_entities(spans, n, support), "entities")
    terms = materialize(held_terms(docs, held, n, support, generalise), "terms")
    pairs = beside(held, terms, n, generalise)
    telling = materialize(disclosures(pairs, n, support, generalise), "telling")
    flagged = occurrences(docs, pairs, telling).select(
        "rid", "start", F.when(F.col("share") >= remove, F.lit(KINDS.index("remove")))
        .otherwise(F.lit(KINDS.index("generalise"))).alias("kind"), "end")
    every = spans.select("rid", "start", "kind", "end").unionByName(flagged)
    # A term inside a base span goes: a base span before it in the order ends behind
    # its start, or one after it starts before its end.
    is_base = F.col("kind") < len(BASE)
    place = Window.partitionBy("rid").orderBy("start", "kind", "end")
    over_end = F.max(F.when(is_base, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, 0))
    next_start = F.min(F.when(is_base, F.col("start"))).over(place.rowsBetween(0, Window.unboundedFollowing))
    every = every.select("*", over_end.alias("over_end"), next_start.alias("next_start")).where(
        is_base | ~(F.coalesce(F.col("over_end") > F.col("start"), F.lit(False))
                    | F.coalesce(F.col("next_start") < F.col("end"), F.lit(False))))
    lists = every.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return docs.select("rid", "doc_id").join(lists, "rid", "left").select(
        "rid", "doc_id", F.coalesce("spans", none).alias("spans"))


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``rid, doc_id, text`` with base spans and generalised terms replaced by their
    class in angle brackets and removed terms taken out; of overlapping spans the
    first counts."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    label = F.array(*[F.lit("" if k == "remove" else "<WORD>" if k == "generalise" else f"<{k.upper()}>") for k in KINDS])
    joined = docs.select("rid", "doc_id", "text").join(spans.select("rid", "spans"), "rid")

    def step(acc: Column, s: Column) -> Column:
        piece = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, F.element_at(label, s["kind"] + 1))).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(new)

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))

    return joined.select("rid", "doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(
        F.aggregate("spans", start, step, finish)).alias("text"))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op1_information_pii")
def op1_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``, and the terms that reveal it."""
    found = find_spans(keyed(documents(spark, sf_dir)))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        count("generalise").alias("n_generalise"), count("remove").alias("n_remove"))
