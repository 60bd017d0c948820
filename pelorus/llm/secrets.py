"""Secret scans: two character Markov models, of random strings and of ordinary
identifiers, compared by log-likelihood ratio.  DataFrame functions only.

Places come from splitting a text at a pattern: the pieces between matches and
the matches themselves, in order, give every match its offset.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm.common import pick

# The base patterns by kind, in listed order, with the group whose length counts and the least length.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = [
    ("assign", ASSIGN, 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    # maximal runs of 16 and more are what [0-9a-f]+ finds and a least length of 16 keeps
    ("hex", "(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
]
#: Strings that the models judge.
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
# Words that ordinary identifiers are made of, from the whole alphabet.
WORDS = """
account action active address agent alert alias amount answer archive array article asset audio author average
backup balance batch before binary block board border branch bridge browser buffer build button cache calendar
callback camera cancel capture category center change channel chart check child client cluster code collection
column command comment common company config connection console content context control convert counter country
create current customer data database date default delete delivery device dialog digest directory display document
domain download driver editor element email employee enable engine entry error event example execute export
factor failure feature fetch field figure file filter final first fixture flag float folder font footer force format
forward frame free frequency front function future gallery gateway general generate global grade grant graph grid group
guard guest guide half hand handle hardware hash header health height hello help hidden high history holder home host
hour hook icon identity image import index info input insert instance integer invoice issue item iterator january job
join journal json jump junior just keep kernel key keyboard kind knowledge known label language large last latency layer
layout leader left length level library license limit line link list local location lock login logger lookup loop
machine mail main manager map margin market master match matrix maximum member memory menu merge message method metric
minimum mode model module monitor month mount move name native network next node normal notify number object offset
online open operator option order origin output owner package page panel parent parse partner path pattern payment
people permission phone pixel player plugin point policy popup port position power prefix previous price print priority
private process product profile project property protocol provider proxy public purchase push quality quantity quarter
query question queue quick quiet quota quote random range rate reader record redirect reference refresh region register
release remote render report request reset resource response result return review right role root route rule runtime
sample scale schedule schema scope score screen script search section select sequence server service session setting
shape share signal size slot sort source space stack start state status step stop storage stream string style subject
submit summary support switch symbol sync system tab table tag target task team template tenant terminal test text
theme thread threshold time timeout title toggle tool topic total trace track transfer transform tree trigger type unit
unknown update upload usage user utility vacuum valid value variable vector vendor verify version vertex video view
virtual visible volume voucher wait walk warehouse warning watch weather web week weight widget width window wizard word
worker workflow wrapper write writer xaxis xml yaml year yellow yield young zero zip zone zoom
""".split()


def labelled_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled strings made by rule: ``sample``, ``random`` (boolean).  ``n``
    random ones (parts of digests in hex of either case, base 64 of either kind and
    base 36 of either case) and
    ``n`` identifiers (two to four words in snake, kebab, camel or path case or as
    upper-case constants, some with a short number)."""
    ids = spark.range(n).select("id", F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")).cast("binary"), 256).alias("hex"))
    b64 = F.regexp_replace(F.base64(F.unhex("hex")), "[=\\r\\n]", "")
    kinds = [F.substring("hex", 1, 40), b64, F.substring(F.upper(b64), 1, 24), F.substring(F.lower(b64), 1, 24), F.substring(F.upper("hex"), 1, 40), F.translate(b64, "+/", "-_")]
    strong = F.get(F.array(*kinds), F.pmod("id", F.lit(len(kinds))).cast("int"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick_word = lambda k: F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))).cast("int"))
    chosen = F.slice(F.array(*[pick_word(k) for k in range(4)]), F.lit(1), (F.lit(2) + F.col("id") % 3).cast("int"))
    camel = F.array_join(F.transform(chosen, lambda w: F.initcap(w)), "")
    plain = F.when(F.col("id") % 5 == 0, F.array_join(chosen, "_")).when(F.col("id") % 5 == 1, F.array_join(chosen, "-")).when(F.col("id") % 5 == 2, camel).when(F.col("id") % 5 == 3, F.array_join(chosen, "/")).otherwise(F.array_join(chosen, ""))
    plain = F.when(F.col("id") % 10 == 5, F.upper(plain)).otherwise(plain)  # half of those in snake case
    plain = F.when(F.col("id") % 7 == 0, F.concat(plain, (F.col("id") % 100).cast("string"))).otherwise(plain)
    both = ids.select(strong.alias("sample"), F.lit(True).alias("random")).union(ids.select(plain.alias("sample"), F.lit(False).alias("random")))
    return both.repartition(2)  # else the expressions above move into the loops over each string's characters


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio (nats) of each pair of characters under a Markov
    model of random strings against one of identifiers, additively smoothed;
    flat, row by row of ``ALPHABET``.  At most 2 * 66 * 66 counts reach the
    driver, whatever the number of samples.  Null samples count nothing."""
    rows = pick(samples, "sample", "random").where("sample is not null and random is not null")
    n = len(ALPHABET)
    pairs = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring(F.col("sample"), i, F.lit(2)))
    pairs = rows.where(F.length("sample") > 1).select("random", F.explode(pairs).alias("pair"))
    place = lambda k: F.instr(F.lit(ALPHABET), F.substring("pair", k, 1))
    counts = pairs.select("random", place(1).alias("a"), place(2).alias("b")).where("a > 0 and b > 0").groupBy("random", "a", "b").count()
    seen = {(r[0], r[1] - 1, r[2] - 1): r[3] for r in counts.collect()}
    out = []
    for a in range(n):
        total = {k: sum(seen.get((k, a, b), 0) for b in range(n)) + smoothing * n for k in (True, False)}
        out += [log((seen.get((True, a, b), 0) + smoothing) / total[True]) - log((seen.get((False, a, b), 0) + smoothing) / total[False]) for b in range(n)]
    return out


def ratio(string: F.Column, model: list[float]) -> F.Column:
    """Log-likelihood ratio of a string; above 0 it looks random."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # one literal, folded when planned
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(string, i, F.lit(1))) - 1
    return F.when(F.length(string) < 2, 0.0).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.length(string) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(table, (at(i) * len(ALPHABET) + at(i + 1)).cast("int")), F.lit(0.0)))
    )


#: Elements that are scanned at a time.
BLOCK = 256


def _let(value: F.Column, use: Callable[[F.Column], F.Column]) -> F.Column:
    """``use`` of a value that is worked out once; within a lambda, an expression would be for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(items: F.Column, value: Callable[[F.Column], F.Column], merge: Callable[[F.Column, F.Column], F.Column]) -> F.Column:
    """For each of ``items``, the values of those before it, merged from 0.  Growing
    an array copies it, so that this goes by blocks: first each block's total, then
    the running totals, then within the blocks."""
    grow = lambda part, start, f: F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), f(x)))))
    block = lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")))
    totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda acc, x: merge(acc, value(x))))
    within = lambda starts: F.transform(blocks, lambda b: F.slice(grow(block(b), F.get(starts, b), value), F.lit(1), F.least(F.lit(BLOCK), F.size(items) - b * BLOCK)))
    return F.flatten(_let(grow(totals, F.lit(0), lambda x: x), within))


def _matches(text: F.Column, pattern: str) -> F.Column:
    """All matches of a pattern, leftmost first, as (start, string)."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = F.filter(F.arrays_zip(between.alias("gap"), found.alias("hit")), lambda z: z["hit"].isNotNull())
    place = lambda z, before: F.struct((before + z["gap"]).alias("start"), z["hit"].alias("hit"))
    walk = _let(step, lambda s: F.zip_with(s, _running(s, lambda z: z["gap"] + F.length(z["hit"]), lambda a, b: a + b), place))
    return F.when(F.rlike(text, F.lit(pattern)), walk).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))


def _apart(spans: F.Column) -> F.Column:
    """Without the random spans that overlap a base one.  In order of start, a base
    span that overlaps a random one either ends after its start and stands before,
    or is next to it: random spans don't overlap."""
    is_base = lambda s: s["rank"] < len(BASE)
    reach = lambda s: _running(s, lambda x: F.when(is_base(x), x["end"]).otherwise(0), F.greatest)
    clear = lambda s, r, x, i: is_base(x) | ((F.get(r, i) <= x["start"]) & ~F.coalesce(is_base(F.get(s, i + 1)) & (F.get(s, i + 1)["start"] < x["end"]), F.lit(False)))
    return _let(F.array_sort(spans), lambda s: _let(reach(s), lambda r: F.filter(s, lambda x, i: clear(s, r, x, i))))


def _long_enough(found: F.Column, pattern: str, group: int, size: int) -> F.Column:
    return F.filter(found, lambda m: F.length(F.regexp_extract(m["hit"], pattern, group) if group else m["hit"]) >= size)


def _spans(kind: str, rank: int, found: F.Column) -> F.Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["hit"])).alias("end"), F.lit(kind).alias("kind")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None, least: float = 12.0, per_pair: float = 0.4) -> DataFrame:
    """Finds secrets in whole texts.

    ``id_col`` and ``spans``: an array of (start, rank, end, kind), sorted by
    start, then by kind as listed; code points, end exclusive.  Base kinds are
    assign, access and hex.  Kind random is a string of 20 and more characters
    with no base span inside whose log-likelihood ratio is at least ``least``
    and at least ``per_pair`` for each pair of characters, and that holds a
    digit.  Null and empty texts have no spans; repeated rows are scanned one by
    one; an empty table gives an empty table.  One pass, no shuffle.
    """
    model = model or train(labelled_samples(df.sparkSession))
    rows = pick(df, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows
    for kind, pattern, group, size in BASE:
        found = found.withColumn(kind, _long_enough(_matches(F.col("text"), pattern), pattern, group, size))
    found = found.withColumn("random", _matches(F.col("text"), CANDIDATE)).drop("text")
    base = reduce(F.concat, [_spans(k, i, F.col(k)) for i, (k, *_) in enumerate(BASE)])
    odd = F.filter("random", lambda m: F.rlike(m["hit"], F.lit("[0-9]")) & (ratio(m["hit"], model) >= F.greatest(F.lit(least), per_pair * (F.length(m["hit"]) - 1))))
    found = found.select("id", base.alias("base"), _spans("random", len(BASE), odd).alias("random"))
    spans = F.when(F.size("random") == 0, F.array_sort("base")).otherwise(_apart(F.concat("base", "random")))
    return found.select(F.col("id").alias(id_col), spans.alias("spans"))


def report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base kinds, digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return spans.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
