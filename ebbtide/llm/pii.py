"""Personal data and what reveals it: patterns plus information-theoretic sanitisation.

Four patterns find the protected entities.  Offsets come from the text between matches: a match
starts where the pieces and matches before it end, a running sum over the matches of a document.

All words of a document outside its entities are their context: runs without white space, stripped
of punctuation at the edges, in lower case.  Over the whole corpus, with N documents, a word t
discloses an entity e by the share of e's information that t carries:
PMI(t, e) / IC(e) = log(co N / (df(t) df(e))) / log(N / df(e)), at most 1.  Where at least
``SUPPORT`` documents hold both, a share of ``REMOVE_AT`` has the word removed and one of
``GENERALISE_AT`` has it generalised, wherever it stands in a document with that entity.

Everything is DataFrame functions.  Entities in fewer than ``SUPPORT`` documents can have no such word
and form no pairs; counts are aggregated before they are shuffled, and document frequencies are
counted for words that ``SUPPORT`` documents share with an entity only, where these are few enough to
broadcast.

Defined cases: a null text counts as empty; documents without entities keep their text and have
empty span lists; repeated rows are documents of their own; overlapping spans of different kinds
are all listed, and masked once, from the first; empty tables give no rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import WHITE, WORD, if_small, text_of
from ebbtide.llm.rows import placed as written
from ebbtide.operators.lineage import stored

#: The kinds in order and their patterns.  Possessive loops and the look-behind change
#: no match; they spare the regex engine from retrying inside a run and from deep recursion.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){15,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
PUNCTUATION = ".,;:!?()[]\"'"
SUPPORT = 3
REMOVE_AT, GENERALISE_AT = 0.9, 0.7
#: Words that are broadcast at most.
FEW_TERMS = 1_000_000
SPAN = "struct<kind:int,start:bigint,end:bigint,name:string>"


def _valid(kind: Column, match: Column) -> Column:
    """The checks behind the patterns."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    ip = F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3)
                  & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    card = F.length(digits).between(16, 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    phone = F.length(digits).between(8, 15)
    return F.when(kind == 0, F.lit(True)).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


def entities(docs: DataFrame) -> DataFrame:
    """Base spans: __place, kind, start, end, value."""
    text = F.col("__text")
    likely = (F.instr(text, "@") > 0, text.rlike(r"[0-9]\.[0-9]"), text.rlike("[0-9](?:[ -]?[0-9]){15}"),
              F.instr(text, "+") > 0)
    found = F.array(*[
        F.when(likely[k], F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hits"),
                                   F.split(text, p, -1).alias("pieces")))
        for k, p in enumerate(PATTERNS)])
    rows = (docs.select("__place", F.explode(F.filter(found, lambda x: F.size(x["hits"]) > 0)).alias("f"))
            .select("__place", "f.kind", F.posexplode(F.arrays_zip(
                F.slice("f.pieces", F.lit(1), F.size("f.hits")).alias("p"), F.col("f.hits").alias("h"))).alias("pos", "z"))
            .select("__place", "kind", "pos", F.col("z.h").alias("match"), F.length("z.p").cast("long").alias("gap")))
    upto = W.partitionBy("__place", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    value = F.when(F.col("kind") >= 2, F.regexp_replace("match", "[^0-9]", "")).otherwise(F.lower("match"))
    return (rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
            .filter(_valid(F.col("kind"), F.col("match")))
            .select("__place", "kind", "start", "end", value.alias("value")))


def _merged(spans: DataFrame) -> DataFrame:
    """Spans without what earlier ones of the document cover: ``from`` to ``end``, after ``before``."""
    order = W.partitionBy("__place").orderBy("start", F.desc("end"), "kind")
    clear = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (spans.withColumn("before", clear).withColumn("from", F.greatest("start", "before"))
            .filter(F.col("end") > F.col("from")))


def _replaced() -> Column:
    """``__text`` with each of ``__cuts`` (from, before, end, tag) replaced by its tag."""
    return F.concat(
        F.array_join(F.transform("__cuts", lambda s: F.concat(
            F.substring(F.col("__text"), (s["before"] + 1).cast("int"), (s["from"] - s["before"]).cast("int")), s["tag"])), ""),
        F.substring(F.col("__text"), (F.element_at("__cuts", -1)["end"] + 1).cast("int"), F.length("__text")))


def _blanked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with entities (__place, __text), each entity blanked by as many spaces."""
    cuts = (_merged(found).groupBy("__place").agg(F.sort_array(F.collect_list(F.struct(
        "from", "before", "end", F.repeat(F.lit(" "), (F.col("end") - F.col("from")).cast("int")).alias("tag")))).alias("__cuts")))
    return docs.join(if_small(cuts, found), "__place").select("__place", _replaced().alias("__text"))


def _term(word: Column) -> Column:
    return F.lower(F.trim(word, F.lit(PUNCTUATION)))


def _terms() -> Column:
    """The distinct terms of ``__text``."""
    words = F.array_distinct(F.split("__text", f"[{WHITE}]+", -1))
    return F.array_distinct(F.filter(F.transform(words, _term), lambda w: w != ""))


def _document_frequencies(docs: DataFrame, found: DataFrame, blank: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df) of at least the wanted terms, over all documents."""
    plain = docs.join(if_small(found.select("__place").distinct(), found), "__place", "left_anti")
    rows = plain.union(blank).select(F.explode(_terms()).alias("term"))
    terms = stored(wanted.select("term").distinct())
    if terms.count() <= FEW_TERMS:
        rows = rows.join(F.broadcast(terms), "term")
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def disclosing_terms(docs: DataFrame, found: DataFrame, blank: DataFrame, of_entity: DataFrame,
                     held: DataFrame) -> DataFrame:
    """(kind, value, term, share) of the words that disclose an entity."""
    n = docs.agg(F.count("*").alias("n"))
    together = stored(held.groupBy("kind", "value", "term").agg(F.count("*").alias("co")).filter(F.col("co") >= SUPPORT))
    log = lambda x: F.ln(x.cast("double"))
    pmi = log(F.col("co")) + log(F.col("n")) - log(F.col("df")) - log(F.col("de"))
    return (together.join(of_entity, ["kind", "value"]).join(_document_frequencies(docs, found, blank, together), "term")
            .crossJoin(F.broadcast(n))  # one row
            .withColumn("share", F.coalesce(F.try_divide(pmi, log(F.col("n")) - log(F.col("de"))), F.lit(0.0)))
            .filter(F.col("share") >= GENERALISE_AT).select("kind", "value", "term", "share"))


def _occurrences(blank: DataFrame, marked: DataFrame) -> DataFrame:
    """(__place, start, end, share) wherever a marked (__place, term, share) stands in its document."""
    text = F.col("__text")
    rows = (blank.join(marked.select("__place").distinct(), "__place", "left_semi")
            .select("__place", F.posexplode(F.arrays_zip(
                F.split(text, WORD, -1).alias("g"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))).alias("pos", "z"))
            .select("__place", "pos", F.col("z.w").alias("word"), F.length("z.g").cast("long").alias("gap"))
            .filter("word is not null"))
    upto = W.partitionBy("__place").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    edge = F.lit(PUNCTUATION)
    return (rows.withColumn("upto", F.sum(F.col("gap") + F.length("word")).over(upto))
            .select("__place", _term(F.col("word")).alias("term"),
                    (F.col("upto") - F.length(F.ltrim("word", edge))).alias("start"),
                    F.length(F.trim("word", edge)).alias("size"))
            .join(marked, ["__place", "term"])
            .select("__place", "start", (F.col("start") + F.col("size")).alias("end"), "share"))


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with __place and __text, and their spans (__place, base, added)."""
    placed = written(docs).withColumn("__text", text_of())
    slim = placed.select("__place", "__text")
    found = stored(entities(slim))
    blank = stored(_blanked(slim, found))
    mentions = found.select("__place", "kind", "value").distinct()
    of_entity = stored(mentions.groupBy("kind", "value").agg(F.count("*").alias("de")).filter(F.col("de") >= SUPPORT))
    of_place = (mentions.join(if_small(of_entity.select("kind", "value")), ["kind", "value"])
                .groupBy("__place").agg(F.collect_list(F.struct("kind", "value")).alias("entities")))
    # A row for each entity and distinct word of a document.
    held = (blank.join(of_place, "__place").select("__place", F.explode("entities").alias("e"), "__text")
            .select("__place", "e.kind", "e.value", F.explode(_terms()).alias("term")))
    strong = stored(disclosing_terms(slim, found, blank, of_entity, held))
    marked = stored(held.join(if_small(strong), ["kind", "value", "term"])
                    .groupBy("__place", "term").agg(F.max("share").alias("share")))
    added = (_occurrences(blank, marked)
             .groupBy("__place").agg(F.sort_array(F.collect_list(F.struct(
                 F.lit(4).alias("kind"), "start", "end",
                 F.when(F.col("share") >= REMOVE_AT, "remove").otherwise("generalise").alias("how")))).alias("added")))
    base = found.groupBy("__place").agg(F.sort_array(F.collect_list(F.struct(
        "kind", "start", "end", F.lit("mask").alias("how")))).alias("base"))
    return placed, base.join(added, "__place", "left")


def find_spans(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, counts of the kinds, base and all spans.

    ``base`` and ``added`` are arrays of (kind number, start, end, how) in code points.
    """
    placed, spans = _spans(docs)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,how:string>>")
    return (placed.select("doc_id", "__place").join(spans, "__place", "left")
            .select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` sanitised: entities masked, disclosing words removed or generalised."""
    placed, spans = _spans(docs)
    flat = (spans.select("__place", F.explode(F.concat("base", F.coalesce("added", F.array().cast(
        "array<struct<kind:int,start:bigint,end:bigint,how:string>>")))).alias("s"))
        .select("__place", "s.*"))
    merged = (_merged(flat)
              .withColumn("tag", F.when(F.col("start") < F.col("before"), "")
                          .when(F.col("how") == "remove", "")
                          .otherwise(F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in (*KINDS, "term")]),
                                                                        F.col("kind"))), F.lit("]"))))
              .groupBy("__place").agg(F.sort_array(F.collect_list(F.struct("from", "before", "end", "tag"))).alias("__cuts")))
    return (placed.join(merged, "__place", "left")
            .select(*[F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(_replaced()).alias("text") if c == "text"
                      else F.col(f"`{c}`") for c in docs.columns]))
