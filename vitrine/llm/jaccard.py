"""N-gram Jaccard join: universe partition with the pigeonhole principle, verified exactly.

Sets are collapsed to one representative for each different set. Sizes fall into bands; a pair is looked for in the
band of its smaller set. There the universe of 64-bit shingle hashes is cut into m equal segments. Two sets of the
band that reach the threshold differ in at most H shingles, so if the budgets v of the segments (1: the segments must
be equal; 2: they may differ in one shingle) sum up to H + 1, one segment meets its budget. Sets are indexed by the
segment's subset, and for budget 2 also by the subset's one-deletion neighbourhood. The costs of keys and of chance
matches choose how many segments of each kind a band has. A segment that is empty in a set gives no key (all sets
without shingles there would meet); slack pays for such segments, and a set whose budget falls short nevertheless is
also indexed by each of its shingles. So every pair that reaches the threshold shares a key.

Sets that share a key meet at the smallest set of the key (its pivot). A pivot's family is small as a rule; large ones
are dealt as pairs of blocks, so n near copies of one text cost n squared comparisons and n / FAMILY_BLOCK copies of each
text. In a family all pairs are decided exactly on the shingles themselves, by postings,
and a spanning forest of the links goes out: it has the components of all links and at most one row for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.components import components
from vitrine.llm.storage import discard, free_name, shuffle_partitions, stored
from vitrine.llm.words import chunks, find_words, mix64, ragged, text_buffers

SHINGLE_WORDS, NUM, DEN = 4, 85, 100
#: Members of a family, and shingles that they have together, that one task takes; a larger family is dealt as pairs of
#: blocks of about this size.
FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 1 << 19
#: A key that so many classes share, by a part of the classes (one of HOT_PART), is handled apart.
HOT_KEY, HOT_PART = 1 << 14, 64
#: Ids that are broadcast at once, about (16 bytes each, before the hash table).
BROADCAST_IDS = 500_000
#: What a key costs, and what the chance match of a subset of one shingle costs; each further shingle makes it 4 times less likely.
KEY_COST, CHANCE_COST = 1.0, 64.0

_U = np.uint64


def _poisson(mean: float, most: int) -> float:
    """About the chance that a count of this mean is at most `most`."""
    if mean > 200 or most > 200:
        return 1.0 if most >= mean + 5 * sqrt(mean) else 0.0
    term = total = exp(-mean)
    for k in range(1, most + 1):
        term *= mean / k
        total += term
    return min(1.0, total)


@cache
def bands(num: int, den: int) -> list[tuple[int, int, int, int, int, int]]:
    """(smallest size, largest size, H, segments, those with budget 2, salt) of each band, up to sizes no text has.

    H is the largest symmetric difference of two sets at the threshold whose smaller one is of the band.
    """
    found, low = [], 1
    differ = lambda a: ((a + a * den // num) * (den - num)) // (den + num)
    while low < 1 << 34:
        high = max(low, low * 3 // 2 - 1)
        if not found:  # all sizes at which different sets never reach the threshold
            while differ(high + 1) == 0:
                high += 1
        h = differ(high)
        best = None
        for twos in range(0, min(h, 6) + 1):
            for slack in (*range(9), *(x for x in (12, 16, 24, 32, 64, 128, 256, 1024, 1 << 14, 1 << 20) if x <= h)):
                m = max(h + 1 - 2 * twos, 0) + slack + twos
                size = low / m
                short = 1 - _poisson(m * exp(-size), slack)  # such sets are also indexed by each shingle
                chance = (m - twos) * 0.25**size + twos * 0.25 ** max(0.0, size - 1)
                cost = KEY_COST * (m + twos * size + short * low) + CHANCE_COST * (chance + short * low)
                if best is None or cost < best[0]:
                    best = (cost, m, twos)
        found.append((low, high, h, best[1], best[2], len(found)))
        low = high + 1
    return found


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) for chunks of texts: the sorted distinct 64-bit hashes of each text's shingles."""
    for a, b in chunks(offsets):
        words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        word = mix64(words.hashes())[words.codes]
        count = words.per_doc
        first = np.concatenate([[0], np.cumsum(count)])
        # A text with fewer words than a shingle is one shingle; its length is part of the hash.
        pieces = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
        span = np.minimum(count, width)
        at = ragged(first[:-1], pieces)
        size = np.repeat(span, pieces)
        value = size.astype(_U)
        for k in range(width):
            use = size > k
            nxt = value[use] * _U(0x9E3779B97F4A7C15) + word[at[use] + k]
            value[use] = mix64(nxt)
        bounds = np.concatenate([[0], np.cumsum(pieces)])
        out, sizes = [], np.zeros(b - a, np.int64)
        for k in range(b - a):
            own = value[bounds[k] : bounds[k + 1]]
            if len(own):
                own = np.sort(own)
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                own = own[keep]
                out.append(own)
                sizes[k] = len(own)
        yield a, (np.concatenate(out) if out else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 for none."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_keys(hashes: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The index keys of each set, one after the other, and their bounds."""
    size = np.diff(bounds)
    table = bands(num, den)
    lows, highs = np.array([x[0] for x in table]), np.array([x[1] for x in table])
    own = np.searchsorted(lows, np.maximum(size, 1), "right") - 1
    owner, keys = [], []
    for back in (0, 1, 2):
        band = own - back
        near = (band >= 0) & (size > 0) & (size <= highs[np.maximum(band, 0)] * den // num)
        for k in np.unique(band[near]):
            _, _, h, m, twos, salt = table[k]
            if h == 0:
                continue
            rows = np.flatnonzero(near & (band == k))
            n = size[rows]
            values = hashes[ragged(bounds[rows], n)]
            row = np.repeat(rows, n)
            segment = ((values >> _U(32)) * _U(m)) >> _U(32)
            start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])]))
            mixed = mix64(values ^ _U(0xA0761D6478BD642F))
            subset = np.add.reduceat(mixed, start)
            part, part_row = segment[start], row[start]
            length = np.diff(np.append(start, len(values)))
            name = mix64(part * _U(64) + _U(salt + 1))
            owner.append(part_row)
            keys.append(mix64(subset + name))
            budget = np.where(part < _U(twos), np.minimum(length, 2), 1)
            if twos:  # one-deletion neighbourhoods
                two = np.repeat((part < _U(twos)) & (length > 1), length)
                whole = np.repeat(subset, length)[two]
                owner.append(row[two])
                keys.append(mix64(whole - mixed[two] + np.repeat(name, length)[two]))
            short = np.flatnonzero(np.bincount(part_row, weights=budget, minlength=len(size))[rows] < h + 1)
            if len(short):  # not enough segments with shingles: each shingle is a key
                rows = rows[short]
                owner.append(np.repeat(rows, size[rows]))
                keys.append(mix64(hashes[ragged(bounds[rows], size[rows])] + _U(0x5851F42D4C957F2D * (salt + 1) % (1 << 64))))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(size))
    return keys[order].view(np.int64), np.concatenate([[0], np.cumsum(count)])


SETS = "doc_id long, th long, n_shingles long, f1 long, f2 long, keys array<long>"


def _sets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, f1, f2 (a 128-bit fingerprint of the set), and its index keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id, th = batch.column("doc_id"), batch.column("th")
            for a, hashes, bounds in shingle_hashes(*text_buffers(batch.column("text")), width):
                n = len(bounds) - 1
                values, at = set_keys(hashes, bounds, num, den)
                columns = [
                    doc_id.slice(a, n),
                    th.slice(a, n),
                    pa.array(np.diff(bounds)),
                    pa.array(_sums(mix64(hashes + _U(1)), bounds).view(np.int64)),
                    pa.array(_sums(mix64(hashes ^ _U(0xE7037ED1A0B428DB)), bounds).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_shingles", "f1", "f2", "keys"])

    return _texts(docs).mapInArrow(work, SETS)


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def family_links(texts: list[str], width: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of these texts, each pair decided on its shingles; by their places."""
    number: dict[tuple, int] = {}
    members: list[np.ndarray] = []
    for text in texts:
        words = text.encode().lower().split()
        if len(words) > width:
            pieces = set(zip(*(words[k:] for k in range(width)), strict=False))
        else:
            pieces = {tuple(words)} if words else set()
        members.append(np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces)))
    if len(members) == 2:  # most families
        both = len(members[0]) + len(members[1]) - len(number)
        return [(0, 1)] if both and both * den >= num * len(number) else []
    size = np.array([len(m) for m in members], np.int64)
    flat, owner = np.concatenate(members), np.repeat(np.arange(len(members)), size)
    flat, owner = flat[order := np.argsort(flat, kind="stable")], owner[order]
    left = size > 0
    links: list[tuple[int, int]] = []
    at = held = None
    queue: list[int] = []
    while queue or left.any():
        if at is None or 2 * int(left.sum()) < held:  # postings of those alone that nothing has linked yet
            held, use = int(left.sum()), left[owner]
            flat, owner = flat[use], owner[use]
            at = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(number)))])
        x = queue.pop() if queue else int(left.argmax())
        left[x] = False
        own = members[x]
        met = np.bincount(owner[ragged(at[own], at[own + 1] - at[own])], minlength=len(members))
        linked = np.flatnonzero(left & (met * den >= num * (size + size[x] - met)))
        links += [(x, y) for y in linked.tolist()]
        queue += linked.tolist()
        left[linked] = False
        if not left.any():
            break
    return links


def _classes(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(sets, found), both stored: doc_id, th, n_shingles, f1, f2 of all rows; and for the sets that several rows have or
    links reach f1, f2, n_shingles, component (the same for all sets of a component) and least, its smallest doc_id."""
    full = stored(_sets(docs, width, num, den), "sets")
    # A class is all rows with one set; its keys come once, from the row with the smallest doc_id and text hash.
    same = full.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles")
    first = same.agg(F.min_by(F.struct("doc_id", "th", "keys"), F.struct("doc_id", "th")).alias("r"), F.count(F.lit(1)).alias("n_rows"))
    classes = stored(first.select(F.monotonically_increasing_id().alias("cid"), "r.doc_id", "r.th", "r.keys", "f1", "f2", "n_shingles", "n_rows"), "classes")
    sets = stored(full.drop("keys"), "slim")
    discard(full)
    families = _families(classes)
    keyed, classes = classes, stored(classes.drop("keys"), "classes")
    discard(keyed)
    forests = _family_pairs(docs, classes, families, width, num, den)
    reached = components(reduce(DataFrame.unionByName, forests))
    slim = classes.drop("th").join(reached.withColumnRenamed("node", "cid"), "cid", "left").where("n_rows > 1 or component is not null")
    slim = stored(slim.withColumn("component", F.coalesce("component", "cid")), "reached")
    least = slim.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = stored(slim.join(least, "component").select("f1", "f2", "n_shingles", "component", "least"), "found")
    discard(classes, families, *forests, reached, slim)
    return sets, found


def _families(classes: DataFrame) -> DataFrame:
    """pivot, cid: classes that share a key, and the smallest class of that key; stored."""
    rows = classes.select("cid", F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key")
    shared = lambda df: df.select("cid", F.min("cid").over(by_key).alias("pivot"), F.count(F.lit(1)).over(by_key).alias("n")).where("n > 1").select("pivot", "cid")
    # Keys that stand out in a part of the classes are gathered before the shuffle and joined back; which they are changes
    # no result.
    some = rows.where(F.pmod(F.xxhash64("cid"), F.lit(HOT_PART)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(some.where(F.col("n") * HOT_PART >= HOT_KEY).select("key"), "hot")
    if hot.isEmpty():
        out = shared(rows)
    else:
        own = rows.join(hot, "key", "left_semi")
        out = shared(rows.join(hot, "key", "left_anti")).unionByName(own.join(own.groupBy("key").agg(F.min("cid").alias("pivot")), "key").select("pivot", "cid"))
    out = stored(out.distinct(), "families")
    discard(hot)
    return out


def linked_components(docs: DataFrame, width: int = SHINGLE_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of Jaccard >= num/den reach.

    Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; sets of distinct shingles of `width` words, the whole sequence
    where there are fewer. A null or empty text has an empty set and is linked with nothing: its component is its own
    doc_id. Rows may repeat; each row goes by its own text, also where a doc_id has several: those are documents of their
    own that share an id. A row with a null doc_id takes no part, its component is null. A long text is one set as any
    other. Other columns are left alone. An empty table gives an empty result.
    """
    sets, found = _classes(docs, width, num, den)
    every = sets.join(found, ["f1", "f2", "n_shingles"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return every.select("doc_id", "n_shingles", F.when(linked, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _family_pairs(docs: DataFrame, classes: DataFrame, families: DataFrame, width: int, num: int, den: int) -> list[DataFrame]:
    """Spanning forests of all families: tables of a, b, each stored.

    Members' ids are broadcast to the texts, so only texts of members are shuffled. Where there are too many ids for that,
    families are taken in rounds, each with about so many members; a round reads the documents again, but its shuffles are
    gone before the next.
    """
    members = stored(classes.select("cid", "doc_id", "th", "n_shingles").join(families.select("cid").distinct(), "cid", "left_semi"), "members")
    sized = families.join(members.select("cid", "n_shingles"), "cid").groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / FAMILY_BLOCK), F.least(F.ceil(F.col("size") / FAMILY_SHINGLES), F.col("n"))).cast("int")
    large = stored(sized.select("pivot", blocks.alias("blocks")).where("blocks > 1"), "large")
    placed = families.join(large, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    # A member of block i is needed in the tasks (i, j) of all j; most families have one block and one task.
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("pivot", "cid", "block", others).select("pivot", "cid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rounds = max(1, -(-members.count() // BROADCAST_IDS))

    def dealt(turn: int) -> DataFrame:
        own = placed.where(F.pmod(F.hash("pivot"), F.lit(rounds)) == turn)
        named = members.select("cid", "doc_id", "th")
        if rounds > 1:
            named = named.join(own.select("cid").distinct(), "cid", "left_semi")
        needed = _texts(docs).join(F.broadcast(named), ["doc_id", "th"]).groupBy("cid").agg(F.min("text").alias("text"))
        rows = own.join(needed, "cid").withColumn("h", F.xxhash64("pivot", "i", "j"))
        return rows.repartition(shuffle_partitions(docs.sparkSession), "h").sortWithinPartitions("h", "pivot", "i", "j", "cid").drop("h")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Families lie one after the other; one that a batch ends in is carried on."""
        name, ids, texts = None, [], []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(texts) > 1:
                found.extend((ids[x], ids[y]) for x, y in family_links(texts, width, num, den))
            ids.clear()
            texts.clear()

        def out() -> pa.RecordBatch:
            columns = np.array(found, np.int64).reshape(-1, 2).T
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])

        for batch in batches:
            family = zip(*(batch.column(c).to_pylist() for c in ("pivot", "i", "j")), strict=True)
            column = batch.column("text")
            for k, (own, one) in enumerate(zip(family, batch.column("cid").to_pylist(), strict=True)):
                if own != name:
                    close()
                    name = own
                ids.append(one)
                texts.append(column[k].as_py())
            if found:
                yield out()
        close()
        if found:
            yield out()

    forests = [stored(dealt(turn).mapInArrow(decide, "a long, b long"), "links") for turn in range(rounds)]
    discard(members, large)
    return forests


def deduplicated(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One row of each component stays, one with the smallest doc_id and, of its texts, the smallest hash; columns as before.

    Of rows alike in both any one stays. Rows without words or with a null doc_id are linked with nothing and stay, as often
    as they come. Other columns, whatever their names, go along. An empty table gives an empty result.
    """
    sets, found = _classes(docs, width, num, den)
    rows = sets.where("n_shingles > 0 and doc_id is not null").join(found, ["f1", "f2", "n_shingles"]).select("doc_id", "th", "component")
    rows = stored(rows.groupBy("doc_id", "th", "component").agg(F.count(F.lit(1)).alias("alike")), "linked")
    chosen = rows.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("chosen"))
    stays = F.struct("doc_id", "th") == F.col("chosen")
    away = stored(rows.join(chosen, "component").where(~stays | (F.col("alike") > 1)).select("doc_id", "th", stays.alias("stays")), "away")
    few = away.count() <= BROADCAST_IDS
    discard(sets, found, rows)
    own, text_hash, flag = (free_name(c, docs.columns) for c in ("id", "th", "stays"))
    named = away.select(F.col("doc_id").alias(own), F.col("th").alias(text_hash), F.col("stays").alias(flag))
    wide = docs.withColumns({own: F.col("doc_id").cast("long"), text_hash: F.xxhash64(F.col("text").cast("string"))})
    small = lambda df: F.broadcast(df) if few else df
    kept = wide.join(small(named), [own, text_hash], "left_anti").select(*docs.columns)
    if away.where("stays").isEmpty():
        return kept
    # Rows that repeat: one of each stays; they are gathered before the shuffle.
    again = wide.join(small(named.where(flag)), [own, text_hash], "left_semi").dropDuplicates([own, text_hash])
    return kept.unionByName(again.select(*docs.columns))
