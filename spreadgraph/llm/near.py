"""N-gram Jaccard join with rare-first prefixes.

A document is its set of distinct five-word shingles. Shingles are counted over all documents; a document's prefix is its rarest
shingles, as many as must hold one of any partner's prefix, and documents meet on shared prefix shingles. Length, positional and
suffix filters thin the candidates, and each pair is verified once, on its whole sets.

Nothing is quadratic in a group of near copies: in a first round every prefix shingle only pairs its documents with one of them, the
most central; documents that are linked by then form classes, and the second round pairs only documents of different classes. The
result is exact: a link that the second round skips lies inside a class that other links already join. There a pair meets at its first
common shingle, so what either set has before it is not shared: a place far back in a prefix leaves few partners or none, and only sets
of sizes that the places allow are joined. Documents of one long common passage that differ elsewhere don't form pairs at its shingles.

Shuffles carry arrays, not a row per shingle: the counting pass ships sorted tokens a bucket and chunk at a time, and what comes back
are only the shingles that two different sets share. A document of which fewer than 80 % are shared cannot link and goes no further.
Shingles that hold more than a share of 1 / HOT of all are found in a pass of their own and broadcast with their counts: sets name them
at once, and no bucket gathers the many documents of a common passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadgraph.llm.hashing import LOWER, batches_of, joined, mix, word_hashes, word_spans
from spreadgraph.operators.components import connected_components
from spreadgraph.storage import keep, release, ship

WORDS = 5
#: The similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles a task gathers before it ships them, and about how many a counting bucket holds.
CHUNK = 600_000
BUCKET = 1_700_000
LEAST_BUCKETS = 64
#: Prefixes of up to so many shared shingles are carried along in the second round, to emit a pair at its first common one only.
LISTED = 128
#: Bytes of text hashed at once.
HASHED = 3 << 20
#: At most so many shingles are broadcast as frequent ones: each stands for at least one in so many of all.
HOT = 40_000
#: A chunk names the shingles that so many of its sets hold; what it doesn't name is less than a 75,000th of all.
NAMED = 8
#: Sizes of one class of the second round differ by less than this factor.
SIZE_STEP = 1.06

_GOLD = np.uint64(0x100000001B3)
_LOW = np.uint64((1 << 40) - 1)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every distinct shingle, sorted by both. Fewer words than a shingle's: the whole sequence is one."""
    raw, begins = joined(texts)
    buf = LOWER[raw]
    starts, ends = word_spans(buf)
    w = word_hashes(buf, starts, ends)
    owner = np.searchsorted(begins, starts, side="right") - 1
    many = np.bincount(owner, minlength=len(texts))
    hashes, owners = [], []
    if len(w) >= words:
        h = w[: len(w) - words + 1]
        for k in range(1, words):
            h = mix(h * _GOLD + w[k : len(w) - words + 1 + k])
        whole = owner[: len(h)] == owner[words - 1 :]
        hashes.append(h[whole])
        owners.append(owner[: len(h)][whole])
    first = np.concatenate(([0], np.cumsum(many)))
    for length in range(1, words):
        own = np.flatnonzero(many == length)
        if len(own):
            h = np.full(len(own), length, np.uint64)
            for k in range(length):
                h = mix(h * _GOLD + w[first[own] + k])
            hashes.append(h)
            owners.append(own)
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def set_digests(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of each set, its size mixed in, and the sizes."""
    sizes = np.bincount(owner, minlength=n)
    ends = np.cumsum(sizes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x51ED270B)))))
    return mix((sums[ends] - sums[ends - sizes]) ^ mix(sizes.astype(np.uint64))).view(np.int64), sizes


def _pack5(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _bucket_blobs(digests: np.ndarray, sizes: np.ndarray, owner: np.ndarray, hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket (the hashes' top bits): the sets with tokens there, how many each, and the tokens' low 40 bits, set by set."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # within a bucket still by set and hash
    present, at = np.unique(bucket[order], return_index=True)
    for b, own in zip(present.tolist(), np.split(order, at[1:]), strict=True) if len(order) else ():
        sets, counts = np.unique(owner[own], return_counts=True)
        yield b, b"".join((np.int64(len(sets)).tobytes(), digests[sets].tobytes(), sizes[sets].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), _pack5(hashes[own] & _LOW)))


def _shared_tokens(bucket: int, blobs: list[bytes], bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(digest, size, how many, keys) of each set that shares tokens of the bucket with another set.

    A key is the token under the class of its document frequency (quarters of its logarithm), so ascending keys are rare-first.
    """
    digests, sizes, counts, tokens = [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        digests.append(np.frombuffer(blob, np.int64, n, 8))
        sizes.append(np.frombuffer(blob, np.uint32, n, 8 + 8 * n))
        counts.append(np.frombuffer(blob, np.uint32, n, 8 + 12 * n))
        tokens.append(_unpack5(np.frombuffer(blob, np.uint8, -1, 8 + 16 * n)))
    digest, size, count = (np.concatenate(x) for x in (digests, sizes, counts))
    token = np.concatenate(tokens)
    del digests, sizes, counts, tokens
    _, first = np.unique(digest, return_index=True)  # equal sets count once
    once = np.zeros(len(digest), bool)
    once[first] = True
    use = np.repeat(once, count)
    token = token[use]
    owner = np.repeat(np.flatnonzero(once), count[once]).astype(np.int32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    del order
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    run = np.diff(np.append(np.flatnonzero(new), len(token)))
    df = np.repeat(run, run)
    often = df >= 2
    token, owner, df = token[often], owner[often], df[often]
    low = np.uint64(min(40, 56 - bits))
    key = _rank(df) | (np.uint64(bucket) << low) | (token & np.uint64((1 << int(low)) - 1))
    order = np.argsort(owner, kind="stable")
    key, owner = key[order], owner[order]
    sets, at = np.unique(owner, return_index=True)
    for s, part in zip(sets, np.split(key, at[1:]) if len(sets) else [], strict=True):
        yield int(digest[s]), int(size[s]), len(part), part.tobytes()


def _rank(df: np.ndarray) -> np.ndarray:
    """The class of a document frequency, in the top bits of a key."""
    return np.minimum(127, np.round(4 * np.log2(df))).astype(np.uint64) << np.uint64(56)


def _hot_keys(hashes: np.ndarray, tokens: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are frequent shingles, and the keys of those."""
    if not len(tokens):
        return np.zeros(len(hashes), bool), np.empty(0, np.uint64)
    at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
    hot = tokens[at] == hashes
    return hot, ranks[at[hot]] | (hashes[hot] >> np.uint64(8))


def frequent_shingles(docs: DataFrame, text_col: str, limit: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, the keys' top bits) of those that hold at least one in ``limit`` of all, so at most ``limit`` of them.

    Chunks name what NAMED of their sets hold, so the counts of what they don't name stay below NAMED a chunk.
    """

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        waiting = 0
        for b in batches:
            texts = list(b["_raw"])
            for part in batches_of([len(t or b"") for t in texts], HASHED):
                held.append(shingle_sets(texts[part])[1])
                waiting += len(held[-1])
                if waiting >= CHUNK:
                    yield counts(held)
                    held, waiting = [], 0
        yield counts(held)

    def counts(held: list[np.ndarray]) -> pd.DataFrame:
        flat = np.concatenate([*held, np.empty(0, np.uint64)])
        token, n = np.unique(flat, return_counts=True)
        often = n >= NAMED
        return pd.DataFrame({"token": np.append(token[often].view(np.int64), 0), "n": np.append(n[often], len(flat)), "is_all": np.append(np.zeros(int(often.sum()), bool), True)})

    found = keep(docs.select(F.col(text_col).cast("binary").alias("_raw")).mapInPandas(named, "token long, n long, is_all boolean").groupBy("is_all", "token").agg(F.sum("n").alias("n")), "frequent")
    everything = found.where("is_all").agg(F.sum("n")).first()[0] or 0
    rows = found.where("not is_all").where(F.col("n") * limit >= everything).select("token", "n").toPandas()  # at most limit rows
    release(found)
    token, n = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], _rank(n[order])


def _prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def count_shared(docs: DataFrame, name: Column, text_col: str) -> DataFrame:
    """The counting pass. Rows that ``is_doc``: each row's name (text), digest and size. Others: a set's shared shingles in one bucket,
    or its frequent ones (``hot``, from each chunk that holds the set)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = max(LEAST_BUCKETS.bit_length() - 1, int(np.ceil(np.log2(max(total / 7 / BUCKET, 1)))))
    buckets = 1 << bits
    hot_tokens = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def spread(digests: np.ndarray) -> np.ndarray:
            """Rows that only pass through: buckets of their own, copies of one text dealt over all of them."""
            return buckets + (mix(digests.view(np.uint64) + np.arange(len(digests), dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                offsets = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
                digests, sizes, hashes = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3))
                owner = np.concatenate([x[2] + o for x, o in zip(held, offsets, strict=True)])
                _, first = np.unique(digests, return_index=True)
                once = np.zeros(len(digests), bool)
                once[first] = True
                use = once[owner]
                owner, hashes = owner[use], hashes[use]
                hot, keys = _hot_keys(hashes, *hot_tokens.value)
                sets, at = np.unique(owner[hot], return_index=True)
                parts = [p.tobytes() for p in np.split(keys, at[1:])]
                for some in range(0, len(sets), 64):
                    own = sets[some : some + 64]
                    yield pd.DataFrame({"bucket": spread(digests[own]), "doc_id": None, "digest": digests[own], "n": sizes[own], "blob": parts[some : some + 64]})
                rows = list(_bucket_blobs(digests, sizes, owner[~hot], hashes[~hot], bits))
                for at in range(0, len(rows), 16):
                    yield pd.DataFrame({"bucket": [b for b, _ in rows[at : at + 16]], "doc_id": None, "digest": 0, "n": 0, "blob": [x for _, x in rows[at : at + 16]]})
                held.clear()

        for b in batches:
            texts, ids = list(b["_raw"]), b["doc_id"]
            for part in batches_of([len(t or b"") for t in texts], HASHED):
                owner, hashes = shingle_sets(texts[part])
                digests, sizes = set_digests(owner, hashes, part.stop - part.start)
                yield pd.DataFrame({"bucket": spread(digests), "doc_id": ids[part].to_numpy(), "digest": digests, "n": sizes, "blob": None})
                held.append((digests, sizes, owner, hashes))
                total += len(hashes)
                if total >= CHUNK:
                    yield from flush()
                    total = 0
        yield from flush()

    def reduce(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= buckets:
            keys = rows["blob"]
            return rows.assign(is_doc=keys.isna(), hot=keys.notna(), shared=keys.map(len, na_action="ignore").fillna(0).astype("int64") // 8, keys=keys)[columns]
        blobs = list(rows["blob"])
        out = pd.DataFrame(list(_shared_tokens(key[0], blobs, bits)), columns=["digest", "n", "shared", "keys"])
        return out.assign(is_doc=False, hot=False, doc_id=None)[columns]

    columns = ["is_doc", "hot", "doc_id", "digest", "n", "shared", "keys"]

    raw = docs.select(name.alias("doc_id"), F.col(text_col).cast("binary").alias("_raw"))
    shipped = raw.mapInPandas(chunks, "bucket int, doc_id string, digest long, n long, blob binary")
    return keep(shipped.groupBy("bucket").applyInPandas(reduce, "is_doc boolean, hot boolean, doc_id string, digest long, n long, shared long, keys binary"), "shingles")


def candidate_sets(counted: DataFrame) -> DataFrame:
    """``digest, n, keys``: the sets of which enough is shared to link, with their shared shingles rare-first."""
    # a set in many chunks names its frequent shingles in each; all say the same
    own, hot = F.expr("if(hot, null, keys)"), F.expr("if(hot, keys, null)")
    gathered = counted.where("not is_doc").groupBy("digest").agg(F.first("n").alias("n"), F.sum(F.expr("if(hot, 0, shared)")).alias("counted"), F.max(F.expr("if(hot, shared, 0)")).alias("frequent"), F.collect_list(own).alias("parts"), F.first(hot, True).alias("hot"))
    gathered = gathered.withColumn("shared", F.expr("counted + frequent")).withColumn("parts", F.expr("if(hot is null, parts, array_append(parts, hot))"))

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "n": b["n"], "keys": [np.sort(np.frombuffer(b"".join(p), np.uint64)).tobytes() for p in b["parts"]]})

    return keep(gathered.where(f"100 * shared >= {PERCENT} * n").select("digest", "n", "parts").mapInPandas(ordered, "digest long, n long, keys binary"), "sets")


def prefixes(sets: DataFrame) -> DataFrame:
    """``key, digest, n, s, pos, central``: the shared shingles of each set's prefix, how many it has in all (s) and the place among them.

    Shingles of its own come first in a set's prefix and meet nobody.

    ``central`` is the mean frequency class of the set's shingles: of near copies, the text that the others were made from has the most.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for digest, n, keys in zip(b["digest"], b["n"], b["keys"], strict=True):
                k = np.frombuffer(keys, np.uint64)
                own = n - len(k)
                head = k[: max(0, _prefix_length(n) - own)]
                central = float((k >> np.uint64(56)).sum()) / n
                parts.append((head.view(np.int64), digest, n, len(k), np.arange(len(head)), central))
            many = [len(p[0]) for p in parts]
            cat = lambda i, kind: np.repeat(np.array([p[i] for p in parts], kind), many)
            if parts:
                yield pd.DataFrame({"key": np.concatenate([p[0] for p in parts]), "digest": cat(1, np.int64), "n": cat(2, np.int64), "s": cat(3, np.int64), "pos": np.concatenate([p[4] for p in parts]), "central": cat(5, float)})

    return sets.mapInPandas(cut, "key long, digest long, n long, s long, pos long, central double")


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """At most so many common entries of two sorted arrays: split both at the middle of the longer, again and again."""
    if not len(a) or not len(b):
        return 0
    if not depth:
        return min(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    m = len(a) // 2
    at = int(np.searchsorted(b, a[m]))
    hit = int(at < len(b) and b[at] == a[m])
    return hit + suffix_bound(a[:m], b[:at], depth - 1) + suffix_bound(a[m + 1 :], b[at + hit :], depth - 1)


def _alike(common: int, n: int, m: int) -> bool:
    return 100 * common >= PERCENT * (n + m - common)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link: the suffix filter first, then the intersection of the whole sets."""

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            good = []
            for n, m, x, y in zip(t["n_a"], t["n_b"], t["keys_a"], t["keys_b"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                good.append(_alike(suffix_bound(p, q), n, m) and _alike(len(np.intersect1d(p, q, assume_unique=True)), n, m))
            yield t.loc[good, ["a", "b"]]

    side = lambda s: sets.select(F.col("digest").alias(s), F.col("n").alias(f"n_{s}"), F.col("keys").alias(f"keys_{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(checked, "a long, b long")


def _fits(n: str, m: str) -> str:
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def _enough(common: str, n: str, m: str) -> str:
    """So many common shingles at most can still be enough."""
    return f"{100 + PERCENT} * ({common}) >= {PERCENT} * ({n} + {m})"


def _reach(x: str, y: str) -> str:
    """The positional filter for one common shingle of the sets x and y: the shared ones before it, itself, and those after it."""
    before, after = f"least(pos{x}, pos{y})", f"least(s{x} - pos{x}, s{y} - pos{y})"
    return _enough(f"{before} + {after}", f"n{x}", f"n{y}")


def star_pairs(heads: DataFrame) -> DataFrame:
    """``a, b``: for each prefix shingle, its most central set with each of the others; every pair once."""
    hub = heads.groupBy("key").agg(F.max(F.struct("central", "digest", "n", "s", "pos")).alias("h"), F.count("*").alias("c")).where("c > 1")
    hub = hub.select("key", *[F.col(f"h.{c}").alias(f"{c}_h") for c in ("digest", "n", "s", "pos")])
    met = heads.join(hub, "key").where("digest <> digest_h").where(_fits("n", "n_h")).where(_reach("", "_h"))
    return met.select(F.least("digest", "digest_h").alias("a"), F.greatest("digest", "digest_h").alias("b")).distinct()


def listed_prefixes(sets: DataFrame) -> DataFrame:
    """``digest, pre``: the keys of prefixes that are short enough to be carried along."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads = []
            for n, keys in zip(b["n"], b["keys"], strict=True):
                k = np.frombuffer(keys, np.int64)
                heads.append(k[: max(0, _prefix_length(n) - (n - len(k)))])
            few = [len(h) <= LISTED for h in heads]
            yield pd.DataFrame({"digest": b["digest"][few], "pre": pd.Series([h for h, f in zip(heads, few, strict=True) if f], index=b.index[few], dtype=object)})

    return sets.mapInPandas(cut, "digest long, pre array<bigint>")


def meeting_places(heads: DataFrame, classes: DataFrame) -> DataFrame:
    """The prefix shingles at which sets of different classes can be met for the first time: ``key, digest, n, s, pos, class, reach``.

    At a pair's first common shingle at most ``s - pos`` of either set's are common, so the partners of a place have at most
    ``reach = (100 + PERCENT) / PERCENT * (s - pos) - n`` shingles.
    """
    placed = heads.join(classes.select(F.col("node").alias("digest"), F.col("component").alias("class")), "digest", "left").withColumn("class", F.coalesce("class", "digest")).drop("central")
    mixed = placed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    reach = F.expr(f"least(floor({100 + PERCENT} * (s - pos) / {PERCENT}) - n, floor(100 * n / {PERCENT}))")
    return placed.join(mixed, "key", "left_semi").withColumn("reach", reach).where(f"100 * reach >= {PERCENT} * n")


def cross_pairs(heads: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: the sets of different classes that share a prefix shingle and pass the length and positional filters; every pair once.

    The smaller set of a pair meets only sizes from its own up to its reach.
    """
    left = keep(meeting_places(heads, classes).join(listed_prefixes(sets), "digest", "left"), "mixed")
    kind = lambda n: F.floor(F.log(n) / F.lit(float(np.log(SIZE_STEP))))
    x = left.where("reach >= n").withColumn("kind", F.explode(F.sequence(kind(F.col("n")), kind(F.col("reach")))))
    x = x.select("key", "kind", *[F.col(c).alias(f"{c}_a") for c in ("digest", "n", "s", "pos", "class", "pre", "reach")])
    y = left.select("key", kind(F.col("n")).alias("kind"), *[F.col(c).alias(f"{c}_b") for c in ("digest", "n", "s", "pos", "class", "pre", "reach")])
    on = F.expr("class_a <> class_b and n_b <= reach_a and n_a <= reach_b and (n_a < n_b or n_a = n_b and digest_a < digest_b)")
    # a pair of listed prefixes is met once, at its first common shingle; its common prefix shingles are then known
    common = "array_intersect(pre_a, pre_b)"
    once = F.expr("pre_a is null or pre_b is null") | F.expr(f"array_min({common}) = key")
    met = x.join(y, ["key", "kind"]).where(on).where(once)
    pair = [F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")]
    both = met.where("pre_a is not null and pre_b is not null").withColumn("both", F.expr(common)).withColumn("end", F.array_max("both"))
    # all common shingles up to the last one are counted; what follows it can add so many at most
    short = both.withColumn("more", F.expr("least(s_a - array_position(pre_a, end), s_b - array_position(pre_b, end))")).where(_enough("size(both) + more", "n_a", "n_b"))
    return short.select(*pair).unionByName(met.where("pre_a is null or pre_b is null").select(*pair).distinct())


def near_classes(docs: DataFrame, name: Column, text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class``: each row's name (a text column), set size, and class under links (null for empty sets)."""
    ship(docs.sparkSession)
    counted = count_shared(docs, name, text_col)
    sets = candidate_sets(counted)
    heads = keep(prefixes(sets), "prefixes")
    first = keep(star_pairs(heads), "pairs")
    links = keep(verify(first, sets), "links")
    classes = keep(connected_components(links, "a", "b"), "classes")
    second = cross_pairs(heads, sets, classes).join(first, ["a", "b"], "left_anti")
    across = keep(verify(second, sets), "links")
    if across.limit(1).count():
        classes = connected_components(across.union(classes.select("node", "component")), "a", "b")
    release(sets, heads, first, links, across)
    members = counted.where("is_doc").select("doc_id", "digest", F.col("n").alias("n_shingles"))
    placed = members.join(classes.select(F.col("node").alias("digest"), "component"), "digest", "left")
    return placed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "digest")).alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    A-Z are lower-cased; words are runs without ASCII white space. Documents link when the Jaccard similarity of their shingle sets
    is 0.8 or more; equal sets always do. ``component_id`` is the smallest doc_id reachable by links. Null, empty and blank texts have
    an empty set and only themselves. Null ids name a component only if all its ids are null. Sets with equal 64-bit digests and sizes
    count as equal. Very long texts are taken whole. An empty table gives an empty result; extra columns are ignored, whatever their
    names; repeated rows are reported each.
    """
    # ids pass through pandas as text: with a null among them it would make long integers floats
    named = near_classes(docs, F.col(id_col).cast("long").cast("string"), text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    lowest = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = named.where("class is not null").join(lowest, "class").select("doc_id", "n_shingles", "component_id")
    return out.union(named.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each component the row with the smallest id (null ids last).

    Rows with empty sets (null, empty and blank texts) all stay; of rows repeated with the same id and text one stays, of different
    texts of one id the one with the smaller hash. An empty table gives an empty result; extra columns stay, whatever their names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    row_id = F.col(id_col).cast("long")
    name = F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("null")), F.xxhash64(F.col(text_col)).cast("string"))
    named = near_classes(docs, name, text_col).where("class is not null")
    order = F.struct(F.expr("doc_id like 'null:%'").alias("none"), F.split_part("doc_id", F.lit(":"), F.lit(1)).try_cast("long").alias("id"), F.col("doc_id"))
    best = named.groupBy("class").agg(F.min(order).alias("o")).select("class", F.col("o.doc_id").alias("_best"))
    lost = named.join(best, "class").where("doc_id <> _best").select(F.col("doc_id").alias("_name")).distinct()
    single = best.select(F.col("_best").alias("_name"), F.lit(True).alias("_single"))
    packed = docs.select(whole.alias("_row"), name.alias("_name"))
    left = packed.join(lost, "_name", "left_anti").join(single, "_name", "left")
    one = Window.partitionBy("_name").orderBy("_single")
    return left.withColumn("_copy", F.row_number().over(one)).where("_single is null or _copy = 1").select("_row.*")
