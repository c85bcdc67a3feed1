"""Fuzzy line deduplication across all documents (DataFrame operations only).

Lines are normalised (lower case; punctuation and white space part words). Equal
normalised lines form a class. A class has a SimHash of its words, cut into `blocks`
pigeonhole blocks of 16 bits; two classes are candidates if they agree on
blocks - distance blocks, as all do that are at most `distance` bits apart.
Candidates are linked if their words have an edit similarity (1 - word edits /
longer word count) of at least `similarity`. Of each connected group one
occurrence stays: the first by document key, text hash and line number.

The groups are those of the full list of candidate pairs, which is never made:
the members of a bucket (classes that share a key of blocks) are held against its
first member, and only in buckets that this leaves apart, the members of one part
against those of others. A SimHash counts each word of a line once: were repeats
counted, the few most common words of a language would decide its bits, and
unrelated lines would share buckets.

How much of all pairs of the similarity the SimHash reaches is a property of the
method; figures are in the README. With `whole`, what it leaves apart is joined
on runs of words that any similar pair must share (`_runs`): complete, but a run
common to many lines makes all pairs of them.

Lines without a word always stay. Null text stays null. Rows equal in key and
text count as occurrences in turn: the first keeps its lines. Null keys sort
first. Very long lines are compared whole. An empty table gives an empty result.
Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, drop_shuffles, release, settle, unnamed

DISTANCE, BLOCKS, SIMILARITY = 4, 6, 0.8
#: Rows of a candidate table (or numbers in a list table) up to which it is broadcast, at about 50 bytes each; beyond, a sort-merge join.
BROADCAST_ROWS = 500_000
#: Words counted at once: eight counters of eight bits fill a long, the top one of which must not reach 128.
CHUNK = 127
#: 0-9, a-z and what isn't ASCII, less the Latin-1 signs, general punctuation and CJK punctuation.
_NO_WORD = r"[^a-z0-9\x{80}-\x{9F}\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def words(line: Column) -> Column:
    """Lower-case runs of ASCII letters and digits and of non-ASCII characters other than general punctuation."""
    return F.array_remove(F.split(F.lower(line), _NO_WORD), "")


def _class(of: Column) -> Column:
    """Two 64-bit hashes of the words in their order: lines of equal ones are one class."""
    return F.struct(F.xxhash64(of).alias("n1"), F.xxhash64(F.lit(1), of).alias("n2"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, as it comes out of a generator: later uses don't repeat its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, th, pos, words): the lines that have a word; th tells apart different texts of one key."""
    each = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return _once(each, "words", words(F.col("line"))).where("size(words) > 0").drop("line")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """(k, th, pos, n1, n2, len, fp0, fp1, ...): one row per line that has a word; a SimHash of 16 bits a block, in longs."""
    return _lines_of(*_fingerprints(docs, key, text, blocks))


def _lines_of(parts: DataFrame, long: DataFrame) -> DataFrame:
    return parts.where(F.col("own") <= CHUNK).select(long.columns).unionByName(long)


def _fingerprints(docs: DataFrame, key: str, text: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Two settled tables: the lines, those of more than CHUNK different words in parts with their counters, and the fingerprints of these.

    Each distinct word of the line is dealt out and counted once, in partial
    aggregates, so a line crosses the exchange as two longs a block: lane j holds
    eight counters of eight bits, for bits j, j + 8, ... of a word's hash. Lane j
    gives the bits j % 8, j % 8 + 8, ... of long j // 8, lanes 2 b and 2 b + 1 block b.
    """
    lanes = range(2 * blocks)
    each = _once(_lines(docs, key, text), "x", F.struct(_class(F.col("words")).alias("n"), F.size("words").alias("len"), F.array_distinct("words").alias("own")))
    each = each.select("k", "th", "pos", "x.n.n1", "x.n.n2", "x.len", F.size("x.own").alias("own"), F.posexplode("x.own").alias("p", "word"))
    hashes = [(F.xxhash64(F.lit(i), "word") if i else F.xxhash64("word")).alias(f"h{i}") for i in range((2 * blocks + 7) // 8)]
    each = each.select("k", "th", "pos", "n1", "n2", "len", "own", F.expr(f"cast(p div {CHUNK} as int)").alias("chunk"), *hashes)
    counts = [F.sum(F.shiftrightunsigned(f"h{j // 8}", j % 8).bitwiseAND(F.lit(0x0101010101010101))).alias(f"c{j}") for j in lanes]
    same = [F.max(c).alias(c) for c in ("n1", "n2", "len", "own")]
    parts = each.groupBy("k", "th", "pos", "chunk").agg(*same, *counts)
    names = ["k", "th", "pos", "n1", "n2", "len"]
    # Parts are written before the longer lines are picked from them: the exchange is read once.
    fps = _longs([_over_half(F.col(f"c{j}"), F.col("own")) for j in lanes])
    parts = settle(parts.select(*names, "own", *fps, *[F.when(F.col("own") > CHUNK, F.col(f"c{j}")).alias(f"c{j}") for j in lanes]))
    # Longer lines have several chunks: their counters go on in 32 bits, two to a long.
    two = F.lit(0xFF << 32 | 0xFF)
    wide = [F.sum(F.shiftrightunsigned(f"c{j}", 8 * i).bitwiseAND(two)).alias(f"c{j}_{i}") for j in lanes for i in range(4)]
    long = parts.where(F.col("own") > CHUNK).groupBy("k", "th", "pos").agg(*same, *wide)
    return parts, settle(long.select(*names, *_longs([_over_half_wide(j, F.col("own").cast("long")) for j in lanes])))


def _over_half(lane: Column, n: Column) -> Column:
    """Bit 0 of each byte set if the counter in it, at most 127, is over half of n; every other byte at a time, so that no sum leaves its place."""
    places = F.lit(0x00FF00FF00FF00FF)
    lift = (F.lit(127) - F.shiftright(n, 1)).cast("long") * F.lit(0x0001000100010001)
    over = lambda c: F.shiftrightunsigned(c.bitwiseAND(places) + lift, 7).bitwiseAND(F.lit(0x0001000100010001))
    return over(lane).bitwiseOR(F.shiftleft(over(F.shiftrightunsigned(lane, 8)), 8))


def _over_half_wide(lane: int, n: Column) -> Column:
    """The same from counters of 32 bits: 2 c - n + 2^30 - 1 has bit 30 set exactly if c is over half of n. A line can't have 2^30 words."""
    one = F.lit((1 << 32) | 1)
    lift, out = (F.lit((1 << 30) - 1) - n) * one, None
    for i in range(4):
        bits = F.shiftleft(F.shiftright(F.shiftleft(f"c{lane}_{i}", 1) + lift, 30).bitwiseAND(one), 8 * i)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def _longs(lanes: list[Column]) -> list[Column]:
    out: list[Column] = []
    for j, bits in enumerate(lanes):
        if j % 8 == 0:
            out.append(bits)
        else:
            out[-1] = out[-1].bitwiseOR(F.shiftleft(bits, j % 8))
    return [x.alias(f"fp{i}") for i, x in enumerate(out)]


def _keys(distance: int, blocks: int) -> list[Column]:
    """A key per choice of blocks - distance blocks: the number of the choice and the bits of its blocks."""
    out = []
    for number, choice in enumerate(combinations(range(blocks), blocks - distance)):
        masks: dict[int, int] = {}
        for b in choice:
            masks[b // 4] = masks.get(b // 4, 0) | 0x0303030303030303 << b % 4 * 2
        signed = {i: m - (1 << 64) if m >> 63 else m for i, m in masks.items()}
        out.append(F.xxhash64(F.lit(number), *[F.col(f"fp{i}").bitwiseAND(F.lit(m)) for i, m in signed.items()]))
    return out


def _as_chars(of: Column) -> Column:
    """A string with one character per word, of 49,152 by hash: edit distance over it is at most that over the words."""
    return F.decode(F.unhex(F.array_join(F.transform(of, lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(0xC000)) + 0x1000)), "")), "UTF-16BE")


def _numbered(of: Column, among: Column) -> Column:
    """A string with one character per word: the word's place among all words of the pair."""
    code = F.transform(of, lambda w: F.lpad(F.hex(F.array_position(among, w) + 0xFFFF), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _texts(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(nkey, t, c): words and characters of the classes in wanted (nkey, first), read again where they first occur; a document is split once."""
    of_doc = wanted.groupBy("first.k", "first.th").agg(F.collect_list(F.struct("first.pos", "nkey")).alias("at"))  # lines of one document
    of_doc = settle(of_doc)
    small = of_doc.agg(F.sum(F.size("at") + 1)).first()[0] or 0
    source = docs.select(F.col(key).alias("dk"), F.xxhash64(text).alias("dth"), F.col(text).alias("t"))
    found = source.join(F.broadcast(of_doc) if small <= BROADCAST_ROWS else of_doc, F.col("dk").eqNullSafe(F.col("k")) & (F.col("dth") == F.col("th")))
    found = _once(found.select("at", "t"), "parts", F.split("t", "\n")).select(F.explode(F.transform("at", lambda x: F.struct(x["nkey"].alias("nkey"), F.get("parts", x["pos"]).alias("line")))).alias("x"))
    found = _once(found.select("x.nkey", "x.line"), "words", words(F.col("line")))
    return found.select("nkey", F.array_join("words", " ").alias("t"), _as_chars(F.col("words")).alias("c"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes, by their id or else (n1, n2), whose words are similar enough."""
    pairs = settle(pairs.distinct())
    n = pairs.count()
    if not n:
        return pairs
    wanted = pairs.select(F.col("a").alias("nkey")).union(pairs.select("b")).distinct()
    nkey = F.col("id") if "id" in classes.columns else F.struct("n1", "n2")
    wanted = classes.select(nkey.alias("nkey"), "first").join(F.broadcast(wanted) if 2 * n <= BROADCAST_ROWS else wanted, "nkey", "left_semi")
    texts = settle(_texts(wanted, docs, key, text).dropDuplicates(["nkey"]))
    both = pairs.join(texts.toDF("a", "ta", "ca"), "a").join(texts.toDF("b", "tb", "cb"), "b").withColumn("longer", F.greatest(F.length("ca"), F.length("cb")))
    # Cheap tries with few edits first: the cost of a try grows with the edits it allows.
    limit = [f"cast(floor({(1 - similarity) * share}D * longer + 1e-9D) as int)" for share in (0.1, 0.3, 1)]
    near = both.where(F.expr(" or ".join(f"levenshtein(ca, cb, {x}) >= 0" for x in limit)))
    # Exact unless two different words of the pair have one character; then the words are numbered.
    near = _once(near, "all", F.array_union(F.split("ta", " "), F.split("tb", " ")))
    clear = F.size("all") == F.size(F.array_distinct(F.split(F.concat("ca", "cb"), "")))
    numbered = F.levenshtein(_numbered(F.split("ta", " "), F.col("all")), _numbered(F.split("tb", " "), F.col("all"))) <= F.expr(limit[-1])
    out = settle(near.where(F.when(clear, F.lit(True)).otherwise(numbered)).select("a", "b"))
    release(pairs)
    release(texts)
    return out


def _buckets(classes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(key, id, len): the members of each bucket that several classes share."""
    # Dealt once: counting and picking read the same exchange, since both use all of its columns. Keys hardly repeat, so counting before it gains nothing.
    dealt = classes.select(F.explode(F.array(*_keys(distance, blocks))).alias("key"), "id").repartition("key")
    shared = dealt.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    found = settle(dealt.join(shared.hint("shuffle_hash"), "key").hint("rebalance"))
    out = settle(classes.select("id", "len").join(_small(found), "id").select("key", "id", "len"))
    release(found)
    return out


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _roots(links: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of links (a, b), settled, on top of those found before: of these, only the roots that links touch are gone through again."""
    if more is None:
        return components(links)
    if not links.head(1):
        return more
    ends = links.join(more.toDF("a", "ra"), "a", "left").join(more.toDF("b", "rb"), "b", "left")
    tops = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    moved = more.toDF("node", "was").join(tops.toDF("was", "now"), "was", "left")
    return moved.select("node", F.coalesce("now", "was").alias("root")).union(tops)


def _runs(docs: DataFrame, classes: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """(run, id, x): hashed runs of words, id the first half of the class key, x the line's words, the run's place and whether it is own.

    A line of `len` words may differ from a shorter one by `edits(len)` edits. Of
    edits + 1 runs of it that don't overlap (own), at least one is whole in the
    other, and moved by no more than the edits; so a line gives those and, to meet
    longer ones, all its runs of the lengths that lines up to len / similarity have.
    """
    edits = lambda n: f"cast(floor({1 - similarity}D * {n} + 1e-9D) as int)"
    size = lambda n: f"cast(floor({n} / ({edits(n)} + 1)) as int)"
    longest = f"cast(floor(n / {similarity}D + 1e-9D) as int)"
    each = _lines(docs, key, text).withColumn("n", F.size("words")).where(f"{edits(longest)} > 0")
    each = _once(each, "x", F.struct(F.transform("words", lambda w: F.xxhash64(w)).alias("h"), _class(F.col("words")).alias("c")))
    each = each.select("k", "th", "pos", "n", "x.h", F.col("x.c.n1").alias("id"), F.col("x.c.n2").alias("n2"))
    again = classes.where("n > 1").select(F.col("n1").alias("id"), "n2", "first")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    each = each.join(again, ["id", "n2"], "left").where("first is null or first <=> struct(k, th, pos)")
    run = lambda at, q, own: f"struct(xxhash64(slice(h, {at} + 1, {q})) as run, n as len, {at} as at, {own} as own)"
    owned = f"if({edits('n')} > 0, transform(sequence(0, {edits('n')}), i -> {run('i * ' + size('n'), size('n'), 'true')}), array())"
    sizes = f"array_distinct(transform(filter(sequence(n, {longest}), m -> {edits('m')} > 0), m -> {size('m')}))"
    any_run = f"flatten(transform({sizes}, q -> transform(sequence(0, n - q), i -> {run('i', 'q', 'false')})))"
    each = each.select("id", F.expr(f"inline(concat({owned}, {any_run}))"))
    # Few columns for the exchange.
    return each.select("run", "id", F.expr("shiftleft(cast(len as long), 33) | shiftleft(cast(at as long), 1) | cast(own as long)").alias("x"))


def _missed(docs: DataFrame, classes: DataFrame, roots: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """(a, b): all pairs of classes not connected by `roots` whose words may be similar enough; none that is gets lost."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drop_shuffles(docs.sparkSession)
    keyed = _runs(docs, classes, key, text, similarity).repartition(n, "run")
    shared = keyed.groupBy("run").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.bit_or("x").alias("any")).where("low <> high and any & 1 = 1")
    many = settle(keyed.join(shared.select("run"), "run").distinct())
    of = classes.select(F.col("n1").alias("half"), F.col("id").alias("nkey")).join(roots, F.col("nkey") == F.col("node"), "left")
    of = of.select("half", "nkey", F.coalesce("root", "nkey").alias("root"))
    placed = many.withColumnRenamed("id", "half").join(of, "half").select("run", "nkey", "root", F.expr("cast(shiftright(x, 33) as int) as len"), F.expr("cast(shiftright(x, 1) & 4294967295 as int) as at"), F.expr("x & 1 = 1 as own"))
    mixed = placed.groupBy("run").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("run")
    placed = settle(placed.join(mixed, "run"))
    release(many)
    edits = f"floor({1 - similarity}D * u.len + 1e-9D)"
    met = placed.where("own").alias("u").join(placed.where("not own").alias("v"), "run").where(
        f"u.root <> v.root and v.len <= u.len and u.len - v.len <= {edits} and abs(u.at - v.at) <= {edits}"
    )
    return met.select(F.least("u.nkey", "v.nkey").alias("a"), F.greatest("u.nkey", "v.nkey").alias("b"))


def groups(docs: DataFrame, occurrences: DataFrame, key: str, text: str, similarity: float, distance: int, blocks: int, whole: bool = False) -> DataFrame:
    """(n1, n2, keep): classes in groups of two occurrences or more; keep is the occurrence that stays."""
    fps = [c for c in occurrences.columns if c.startswith("fp")]
    first = [F.count("*").alias("n"), F.min(F.struct("k", "th", "pos")).alias("first"), F.max("len").alias("len"), *[F.max(c).alias(c) for c in fps]]
    # Once written, a class goes by one long: sixteen bytes in a struct are slow to sort and group.
    classes = settle(occurrences.groupBy("n1", "n2").agg(*first).withColumn("id", F.monotonically_increasing_id()))
    drop_shuffles(docs.sparkSession)  # of the words and of the classes, before the keys are dealt
    verified = lambda pairs: _verified(pairs, classes, docs, key, text, similarity)
    fits = lambda a, b: F.expr(f"least({a}, {b}) >= {similarity}D * greatest({a}, {b})")
    # Shorter lines than that have no room for an edit.
    shared = _buckets(classes.where(f"floor({1 - similarity}D * floor(len / {similarity}D + 1e-9D) + 1e-9D) > 0"), distance, blocks)

    drop_shuffles(docs.sparkSession)

    # 1. Members against the first of their bucket.
    lead = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead"), F.min_by("len", "id").alias("lead_len"))
    members = settle(shared.join(lead, "key"))
    led = members.where("id <> lead").where(fits("len", "lead_len"))
    roots = _roots(verified(led.select(F.col("lead").alias("a"), F.col("id").alias("b"))))
    # 2. Where that leaves a bucket of three or more apart: its pairs that aren't connected.
    placed = members.where("n > 2").select("key", "id", "len").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    placed = settle(placed.withColumn("root", F.coalesce("root", "id")))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    apart = settle(placed.join(mixed, "key"))
    rest = apart.alias("a").join(apart.alias("b"), "key").where(fits("a.len", "b.len") & F.expr("a.id < b.id and a.root <> b.root"))
    roots = _roots(verified(rest.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))), roots)
    # 3. Lines whose fingerprints are further apart.
    if whole:
        roots = _roots(verified(_missed(docs, classes, roots, key, text, similarity)), roots)
    of = settle(roots.union(roots.select("root", "root")).distinct().toDF("id", "root"))
    again = classes.select("id", "n1", "n2", "n", "first").join(_small(of), "id", "left").where("n > 1 or root is not null")
    again = settle(again.select("n1", "n2", "first", F.coalesce("root", "id").alias("root")))
    out = settle(again.join(again.groupBy("root").agg(F.min("first").alias("keep")), "root").select("n1", "n2", "keep"))
    for x in (shared, members, placed, apart, of, again, classes):
        release(x)
    return out


def dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    whole: bool = False,
) -> DataFrame:
    """docs with the text less the lines that other occurrences stand for, and _n_lines, _n_removed.

    For more than 10^10 lines take more blocks, so that keys of more bits keep
    unrelated lines apart. whole: all pairs of the similarity count, not only
    candidates of the SimHash.
    """
    names = docs.columns
    docs, key, text = unnamed(docs, key, text)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00null"))
    named = docs.withColumns({"_id": name(key), "_hash": F.xxhash64(text)})
    same = ["_id", "_hash"]
    # Texts are read only if a key occurs again, and then only those of such keys are hashed.
    often = settle(named.groupBy("_id").count().where("count > 1").select("_id"))
    twice, repeats, once = often, bool(often.head(1)), docs
    if repeats:
        twice = settle(named.join(_small(often), "_id", "left_semi").groupBy(*same).count().where("count > 1").select(*same))
        repeats = bool(twice.head(1))
    if repeats:  # lines are counted by key, text and place: of rows equal in key and text one is read
        again = named.join(twice, same, "left_semi").dropDuplicates(same)
        once = named.join(twice, same, "left_anti").unionByName(again).drop(*same)
    written = _fingerprints(once, key, text, blocks)
    occurrences = _lines_of(*written)
    grouped = groups(once, occurrences, key, text, similarity, distance, blocks, whole)
    dropped = occurrences.select("k", "th", "pos", "n1", "n2").join(_small(grouped), ["n1", "n2"]).where("not (keep <=> struct(k, th, pos))")
    gone = settle(dropped.groupBy(name("k").alias("_k"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_gone")))
    for x in (*written, grouped):
        release(x)
    small = gone.agg(F.sum(F.size("_gone") / 10 + 1)).first()[0] or 0  # in rows of about 50 bytes
    out = named.join(F.broadcast(gone) if small <= BROADCAST_ROWS else gone, (F.col("_id") == F.col("_k")) & (F.col("_hash") == F.col("_th")), "left")
    if repeats:
        # Rows equal in key and text take turns; only they are numbered.
        again = out.join(twice, same, "left_semi").withColumn("_turn", F.expr("row_number() over (partition by _id, _hash order by _hash)"))
        out = out.join(twice, same, "left_anti").withColumn("_turn", F.lit(1)).unionByName(again)
    else:
        out = out.withColumn("_turn", F.lit(1))
    # Only texts that lose lines are split; out of a generator, so once, not where each of the expressions below needs the lines.
    changed = (F.col("_turn") > 1) | F.col("_gone").isNotNull()
    newlines = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))  # not counting characters
    out = _once(out, "_x", F.struct(F.when(changed, F.split(text, "\n")).alias("parts"), (newlines + 1).alias("n")))
    parts, n = F.col("_x.parts"), F.col("_x.n")
    gone_here = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.when(F.col("_turn") == 1, F.array_except(F.sequence(F.lit(0), n - 1), gone_here))
    later = F.array_join(F.filter(parts, lambda x: F.size(words(x)) == 0), "\n")
    new = F.when(F.col(text).isNull(), F.lit(None).cast("string"))
    new = new.when((F.col("_turn") == 1) & F.col("_gone").isNull(), F.col(text))
    new = new.when(F.col("_turn") == 1, F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")).otherwise(later)
    left = F.when(F.col(text).isNull(), F.lit(0)).when(F.col("_turn") == 1, n - F.size(gone_here)).otherwise(F.size(F.filter(parts, lambda x: F.size(words(x)) == 0)))
    return out.withColumns({"_n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n), "_left": left, text: new}).select(
        *docs.columns, "_n_lines", (F.col("_n_lines") - F.col("_left")).alias("_n_removed")
    ).toDF(*names, "_n_lines", "_n_removed")
