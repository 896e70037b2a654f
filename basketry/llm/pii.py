"""Information-theoretic sanitisation of personal data.

Everything is DataFrame functions. Protected entities are the base matches: e-mail
addresses, IP addresses, payment cards and phone numbers. A text is split by a kind's
pattern; the lengths of the gaps and matches, added up, are the positions.

A term of an entity's document may give the entity away, wherever it stands there. Over
the whole corpus, with document counts n(t), n(e), n(t, e) of a term, an entity, and of
both, the share of the entity's information that the term discloses is

    PMI(t; e) / IC(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)),

1 for a term that stands only with the entity, at most 0 for one that is independent.
Every observed pair is scored, also that of an entity of one document: there the share is
1 - log n(t) / log N, so it falls with the documents that a term stands in. Terms that
disclose at least ``GENERALISE`` of an entity are generalised (kind ``term``), from
``REMOVE`` on removed (kind ``remove``), at all their places in the entity's documents
that no base span touches. Base spans stay.

A term is a run of letters, marks and digits: of three or more characters, or shorter
and begun by a capital or by a letter of a script without case, or of a letter and a
digit. Runs are not cut into words, so a name inside a longer run of a script that is
written without spaces is judged with its run.

Entities with the same documents have the same counts and shares, so they are one class:
a text with thousands of addresses of its own is one class with each of its terms, not
thousands. As n(t, e) is at most n(e), a share of ``GENERALISE`` needs
n(t) <= n(e) (N / n(e))^(1 - GENERALISE); terms over that bound for all entities of a
document meet none of them, and nothing that could be told is lost.

Only rows of matches and, of documents with a match, rows of terms are shuffled, never
texts. Term counts are combined on the map side. Term counts and disclosing pairs are
broadcast when they are at most ``BROADCAST_TERMS``, else joined; frequent entities meet
in joins that are split at run time.

Defined cases: null text is empty and has no spans; repeated rows each give a row and
each count as a document; null ids are carried; a corpus of one document has no
information to disclose, so no terms. Empty tables give empty results. Extra columns are
ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import id_text, written

# The base kinds in their order. The patterns match what the plain ones do
# ([A-Za-z0-9._%+-]+@..., and so on); possessive repeats and the look-behind keep long
# runs linear: a match starts at the start of a run or where the last match ended.
KINDS = ("email", "ip", "card", "phone", "term", "remove")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERALISE = 0.7
REMOVE = 0.95
BROADCAST_TERMS = 500_000
_W, _FIRST = r"[\p{L}\p{M}\p{N}]", r"[\p{Lu}\p{Lt}\p{Lo}]"
_TERM = rf"{_W}{{3,}}+|(?<!{_W})(?:{_FIRST}{_W}?+|\p{{L}}\p{{N}}|\p{{N}}\p{{L}})(?!{_W})"


def _digits(c):
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c):
    """Every second digit from the right is doubled, its digits added; the sum ends in 0."""
    d = F.reverse(_digits(c))
    n = F.length(d)
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(
        i % 2 == 1, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i)))
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, c):
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return c.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(c)
    return F.length(_digits(c)).between(9, 15)


def _found(pattern: str, event):
    """An array of ``event(gap, match, index)`` over the matches of a pattern, in order."""
    text = F.col("text")
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(gaps.alias("g"), found.alias("m"))
    return F.transform(F.filter(zipped, lambda x: x.getField("m").isNotNull()),
                       lambda x, i: event(x.getField("g"), x.getField("m"), i))


def _event(kind: int, i, gap, match, h, ok):
    return F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(gap).alias("gap"), F.length(match).alias("size"),
                    h.alias("h"), ok.alias("ok"))


def _events(kind: str):
    """Per match of a kind, in order: (kind, n, gap, size, h, ok); h is the hash of the entity."""
    text, k = F.col("text"), KINDS.index(kind)
    some = F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") \
        else text.rlike(r"[0-9][ -]?[0-9]" if kind == "card" else r"[0-9]\.[0-9]")
    return F.when(some, _found(PATTERNS[kind], lambda g, m, i: _event(k, i, g, m, F.xxhash64(F.lit(k), m), _valid(kind, m))))


_TERM_KIND = KINDS.index("term")
_EVENT = "array<struct<kind:int,n:int,gap:int,size:int,h:long,ok:boolean>>"


def found_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, h, start, end, free): a row per valid base match, a row per term
    (kind ``term``, h the hash of the lowered term) of the documents with such a match, and
    one of null kind per row of ``docs``. A term is free when no base match touches it."""
    none = F.expr(f"cast(array() as {_EVENT})")
    mark = F.expr("named_struct('kind', cast(null as int), 'n', 0, 'gap', 0, 'size', 0, 'h', cast(null as long), 'ok', true)")
    terms = _found(_TERM, lambda g, m, i: _event(_TERM_KIND, i, g, m, F.xxhash64(F.lower(m)), F.lit(True)))
    # the number of a row is given before its matches are exploded
    rows = (id_text(docs).withColumn("row", F.monotonically_increasing_id())
            .withColumn("base", F.concat(*[F.coalesce(_events(k).cast(_EVENT), none) for k in PATTERNS]))
            .select("row", "doc_id", F.inline(F.concat(
                F.array(mark), "base", F.when(F.exists("base", lambda x: x.ok), terms.cast(_EVENT)).otherwise(none)))))
    order = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(order)
    spans = (rows.withColumn("end", end).where("ok")
             .select("row", "doc_id", "kind", "h", (F.col("end") - F.col("size")).alias("start"), "end"))
    along = Window.partitionBy("row").orderBy("start")
    is_base = F.col("kind") < len(PATTERNS)
    before = F.max(F.when(is_base, F.col("end"))).over(along.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(
        Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("free", (F.col("kind") == _TERM_KIND) & F.coalesce(before <= F.col("start"), F.lit(True))
                            & F.coalesce(after >= F.col("end"), F.lit(True)))


def _small(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, to be broadcast when it has at most ``BROADCAST_TERMS`` rows."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def disclosing(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, h, kind): the terms of a row that disclose at least ``GENERALISE`` of one of its
    entities, of the stronger kind."""
    n_docs = F.lit(float(max(1, spans.where("kind IS NULL").count())))
    base = spans.where(F.col("kind") < len(PATTERNS)).select("row", F.col("h").alias("entity")).distinct()
    # entities with the same documents are one class, known by two sums of hashes of the rows
    sums = [F.sum(F.xxhash64(F.lit(i), "row").cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    of_entity = base.groupBy("entity").agg(F.count("*").alias("ne"), F.xxhash64(*sums, F.count("*")).alias("class"))
    classes = written(base.join(of_entity, "entity").select("row", "class", "ne").distinct(), "pii-classes")
    bound = F.col("ne") * F.pow(n_docs / F.col("ne"), F.lit(1 - GENERALISE)) * 1.000001
    of_row = classes.groupBy("row").agg(F.max(bound).alias("most"))
    terms = spans.where(F.col("kind") == _TERM_KIND).select("row", "h").distinct()

    wanted = _small(terms.select("h").distinct(), "pii-terms")
    each = (id_text(docs).select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), lambda t: F.lower(t)))).alias("t"))
        .select(F.xxhash64("t").alias("h")))
    most = of_row.agg(F.max("most")).first()[0] or 0.0
    of_term = _small(each.join(wanted, "h", "left_semi").groupBy("h").agg(F.count("*").alias("nt"))
                     .where(F.col("nt") <= most), "pii-term-counts")
    rare = terms.join(of_term, "h").join(of_row, "row").where(F.col("nt") <= F.col("most")).select("row", "h", "nt")
    pairs = written(rare.join(classes, "row").where(F.col("nt") <= bound)
                    .select("row", "class", "h", "nt", "ne"), "pii-pairs")
    pmi = F.log(n_docs * F.col("nte") / (F.col("nt") * F.col("ne")))
    information = F.log(n_docs / F.col("ne"))
    told = _small(pairs.groupBy("class", "h", "nt", "ne").agg(F.count("*").alias("nte"))
                  .select("class", "h", F.when(information > 0, pmi / information).alias("share"))
                  .where(F.col("share") >= GENERALISE), "pii-told")
    return (pairs.select("row", "class", "h").join(told, ["class", "h"]).groupBy("row", "h")
            .agg(F.when(F.max("share") >= REMOVE, KINDS.index("remove")).otherwise(_TERM_KIND).alias("kind")))


def protect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_terms, base, all): one row per row of
    ``docs``; base and all are arrays of (start, kind, end) in order."""
    spans = written(found_spans(docs), "pii-spans")
    terms = (spans.where("free").select("row", "h", "start", "end").join(disclosing(docs, spans), ["row", "h"])
             .select("row", F.lit(None).cast("long").alias("doc_id"), "start", "end", "kind"))
    every = (spans.where(F.col("kind").isNull() | (F.col("kind") < len(PATTERNS)))
             .select("row", "doc_id", "start", "end", "kind").unionByName(terms))
    is_base = F.col("kind") < len(PATTERNS)
    item = F.struct("start", "kind", "end")
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *counts, F.count(F.when(~is_base, 1)).alias("n_terms"),
        F.sort_array(F.collect_list(F.when(is_base, item))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("all")).drop("row")


def _listed(name: str):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(name, lambda s: F.concat_ws(
        ":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans)."""
    return protect(docs).select("doc_id", *[f"n_{k}" for k in PATTERNS], "n_terms",
                                F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
                                _listed("all").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every base span replaced by its kind in brackets, disclosing terms
    by [TERM] or by nothing. Every row is a document of its own, whatever its id; of
    overlapping spans the first counts."""
    rows = written(id_text(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = protect(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "base", "all")
    text, spans = F.col("text"), F.col("spans")
    # base spans that start before the end of an earlier one go; terms touch no base span
    spans_free = F.filter("all", lambda s: (s.kind >= len(PATTERNS))
                          | ~F.exists("base", lambda p: (p < s) & (p.end > s.start)))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:-1]], F.lit(""))
    piece = lambda s, i: F.concat(
        F.substr(text, F.coalesce(F.get(spans, i - 1).end, F.lit(0)) .cast("int") + 1,
                 (s.start - F.coalesce(F.get(spans, i - 1).end, F.lit(0))).cast("int")), F.get(labels, s.kind))
    tail = F.substr(text, (F.coalesce(F.get(spans, F.size(spans) - 1).end, F.lit(0)) + 1).cast("int"), F.length(text))
    return (rows.join(found, "row").withColumn("spans", spans_free)
            .select("doc_id", F.concat(F.array_join(F.transform("spans", piece), ""), tail).alias("text")))
