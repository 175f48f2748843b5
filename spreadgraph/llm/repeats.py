"""Removing repeated byte strings by merging shard Burrows-Wheeler transforms.

Which documents share a long string is found first, exactly: the smallest hash among a window's short byte strings (its minimizer) is
the same wherever the window stands, so consecutive windows with one minimizer form a run, and only runs whose minimizer stands in
another run as well can hold repeats. Runs whose minimizer has one text everywhere are settled by that; for the others the runs' texts
are gathered, bucket by bucket, and their suffixes are compared by the named method.

Each chunk's share of a bucket is a shard with its own transform over blocks of BLOCK bytes. The shards' transforms are merged without
sorting suffixes again: the interleave of the shards starts in any order and is refined, one block a round, by dealing each shard's
next transform symbol in interleave order to its symbol's place. The round in which two neighbours part is their common prefix in
blocks; intervals whose prefix reaches WIDTH hold the repeated strings.

A minimizer with over HOT different texts (the edge of a passage that very many documents hold) is never gathered: its windows are
spread by their own 64-bit hashes and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.llm.chunks import bucket_bits, bucket_slices, in_chunks, text_bytes
from spreadgraph.llm.hashing import batches_of, joined, mix, powers, running, window_hashes
from spreadgraph.storage import keep, ship

WIDTH = 400
#: Bytes of the strings that minimizers are taken from.
GRAM = 32
#: Bytes of a transform symbol; divides WIDTH.
BLOCK = 200
#: Different texts of one minimizer that a task may gather.
HOT = 2_000
#: Different texts of one minimizer in a chunk beyond which the chunk names the minimizer once, and it counts as over HOT.
CROWD = 50
CHUNK_BYTES = 3 << 20
#: Bytes of text looked at in one go.
AT_ONCE = 1 << 20
#: About how many runs a counting bucket, and bytes a merging bucket, holds.
RUNS = 300_000
MERGED = 3 << 19

UNIQUE, SETTLED, MIXED, SPREAD = 0, 1, 2, 3


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The minimum or maximum of every ``width`` consecutive values, from running ones inside blocks, forwards and backwards."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    grid = np.concatenate((x, np.full(pad, x[-1], x.dtype))).reshape(-1, width)
    ahead = best.accumulate(grid, axis=1).reshape(-1)
    back = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    """The runs of some texts: text number, first and last window start, minimizer, hash of the run's bytes, and whether the minimizer stands in it twice."""

    def __init__(self, texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
        found = []
        for part in batches_of([len(t) for t in texts], AT_ONCE):
            if part.stop - part.start == 1 and len(texts[part.start]) > 2 * AT_ONCE:
                t = texts[part.start]
                for at in range(0, len(t) - width + 1, AT_ONCE):  # a very long text in overlapping pieces
                    found.append((part.start, at, *self._piece([t[at : at + AT_ONCE + width - 1]], width, gram)))
            else:
                found.append((part.start, 0, *self._piece(texts[part], width, gram)))
        cat = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.empty(0, kind)
        self.text = np.concatenate([f[2] + f[0] for f in found]) if found else np.empty(0, np.int64)
        self.first = np.concatenate([f[3] + f[1] for f in found]) if found else np.empty(0, np.int64)
        self.last = np.concatenate([f[4] + f[1] for f in found]) if found else np.empty(0, np.int64)
        self.key, self.hash, self.twice = cat(5, np.uint64), cat(6, np.uint64), cat(7, bool)

    @staticmethod
    def _piece(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
        buf, begins = joined(texts)
        none = np.empty(0, np.int64)
        if len(buf) < width:
            return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
        span = width - gram + 1
        g = mix(window_hashes(buf, gram))
        low = sliding(g, span, np.minimum)
        # starts whose window stays inside its text
        sizes = np.diff(begins) - 1
        own = np.flatnonzero(sizes >= width)
        valid = np.zeros(len(low) + 1, np.int8)
        np.add.at(valid, begins[own], 1)
        np.add.at(valid, begins[own] + sizes[own] - width + 1, -1)
        ok = np.cumsum(valid[:-1]).astype(bool)
        change = np.ones(len(low), bool)
        change[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
        change[begins[own]] = True
        begin = np.flatnonzero(change)
        end = np.append(begin[1:], len(low)) - 1
        inside = ok[begin]
        run_of = np.cumsum(change) - 1
        # places that are the minimum of some window; two neighbouring ones of one value in one run mean a window may repeat in it
        high = sliding(np.concatenate((np.zeros(span - 1, np.uint64), np.where(ok, low, 0), np.zeros(span - 1, np.uint64))), span, np.maximum)
        at = np.flatnonzero(high == g)
        same = np.flatnonzero(g[at[1:]] == g[at[:-1]])
        left, right = np.minimum(at[same], len(low) - 1), np.maximum(at[same + 1] - span + 1, 0)
        within = (run_of[left] >= run_of[right]) & (left >= right) | (run_of[left] == run_of[right])
        twice = np.zeros(len(begin), bool)
        a, b = run_of[np.minimum(left, right)], run_of[np.maximum(left, right)]
        for x, y in zip(a[within], b[within], strict=True):
            twice[x : y + 1] = True
        begin, end, twice = begin[inside], end[inside], twice[inside]
        text = np.searchsorted(begins, begin, side="right") - 1
        sums = running(buf)
        size = end - begin + width
        whole = mix((sums[begin + size] - sums[begin]) * powers(len(buf))[1][begin] + size.astype(np.uint64))
        return text, begin - begins[text], end - begins[text], low[begin], whole, twice


# ------------------------------------------------------------------------------------------------ transforms and their merge


def shard_transform(texts: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The transform of one shard over symbols of ``block`` bytes.

    Returns the suffix order (places in the texts laid end to end, one place more each for the empty suffix), for each suffix in
    order the symbol before it and whether there is one, and how many suffixes hold no whole symbol: those come first, in any fixed
    order. The others stand by their first symbol and then by the suffix after it; symbols are compared by their hashes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    n = int(begins[-1])
    buf = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    offset = np.arange(n) - np.repeat(begins[:-1], sizes + 1)
    whole = offset + block <= np.repeat(sizes, sizes + 1)
    symbol = np.zeros(n, np.uint64)
    hashed = mix(window_hashes(buf, block))
    symbol[: len(hashed)] = hashed
    symbol[~whole] = 0
    ends = int((~whole).sum())
    rank = np.empty(n, np.int64)
    rank[~whole] = np.arange(ends)
    rank[whole] = ends + np.unique(symbol[whole], return_inverse=True)[1]
    step, longest = 1, int(sizes.max(initial=0)) // block
    while step <= longest:  # what is ahead by as many symbols as are ranked so far
        ahead = np.zeros(n, np.int64)
        reach = n - step * block
        if reach > 0:
            ahead[:reach] = rank[step * block :]
        ahead[offset + step * block > np.repeat(sizes, sizes + 1)] = 0  # such a suffix has a rank of its own already
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    has = offset[order] >= block
    before = np.zeros(n, np.uint64)
    before[has] = symbol[order[has] - block]
    return order, before, has, ends


def _next_in_shard(deal: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each entry of the interleave, its place in its shard's transform, shards laid end to end."""
    by_shard = np.argsort(deal, kind="stable")
    place = np.empty(len(deal), np.int64)
    place[by_shard] = np.arange(len(deal))
    return place


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms by refining their interleave.

    Returns, for the merged order, each suffix's place in the shards' orders laid end to end, and its common prefix with the suffix
    before it in symbols, ``rounds`` standing for that or more. After a round the suffixes stand by one symbol more; two neighbours
    that this round parts agreed on one symbol less. No symbol of a suffix but the one before it is read, nor are suffixes sorted.
    """
    sizes = np.array([len(s[0]) for s in shards], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    before, has = np.concatenate([s[1] for s in shards]), np.concatenate([s[2] for s in shards])
    ends = np.array([s[3] for s in shards], np.int64)
    kind = np.uint16 if len(shards) < 1 << 16 else np.int64
    number = np.arange(len(shards), dtype=kind)
    closed = np.repeat(number, ends)  # suffixes without a whole symbol lead, each a group of its own
    deal = np.concatenate((closed, np.repeat(number, sizes - ends)))
    n, fixed = len(deal), len(closed)
    common = np.full(n, rounds, np.int64)
    common[: fixed + 1] = 0
    for done in range(rounds):
        place = _next_in_shard(deal, starts)
        source = np.flatnonzero(has[place])
        symbol = before[place[source]]
        group = np.cumsum(common < rounds)[source] if done else np.zeros(len(source), np.int64)  # no symbol read: all alike
        dealt = np.argsort(symbol, kind="stable")
        symbol, group = symbol[dealt], group[dealt]
        parted = np.zeros(n, bool)
        if len(symbol) > 1:
            parted[fixed + 1 :] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        common[parted & (common == rounds)] = done
        deal = np.concatenate((closed, deal[source[dealt]]))
    return _next_in_shard(deal, starts), common


def repeated_starts(shards: list[tuple[list[bytes], np.ndarray]], width: int = WIDTH, block: int = BLOCK) -> list[list[np.ndarray]]:
    """For every text of every shard, which of its windows of ``width`` bytes stand anywhere else too.

    A shard is its texts and whether each stands more than once.
    """
    rounds = width // block
    made = [shard_transform(texts, block) for texts, _ in shards]
    place, common = merge_transforms(made, rounds)
    begin = np.flatnonzero(common < rounds)
    size = np.diff(np.append(begin, len(place)))
    several = np.empty(len(place), bool)
    several[place] = np.repeat(size >= 2, size)
    out, at = [], 0
    for (texts, many), (order, _, _, _) in zip(shards, made, strict=True):
        flags = np.empty(len(order), bool)
        flags[order] = several[at : at + len(order)]
        at += len(order)
        own, base = [], 0
        for t, m in zip(texts, many, strict=True):
            own.append(flags[base : base + len(t) - width + 1] | bool(m))
            base += len(t) + 1
        out.append(own)
    return out


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# ------------------------------------------------------------------------------------------------ distribution


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    lengths = np.frombuffer(blob, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for length, kind in zip(lengths, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, int(length), at))
        at += int(length) * np.dtype(kind).itemsize
    return out


_STATE = ("i4", "i8", "i8", "i4", "u8", "u1", "i4")  # of runs: text, first, last, entry; of entries: key, whether the text stands twice, place among those sent
_ENTRY = ("u8", "u8", "u1", "u1", "u1")  # key, hash, texts in the chunk (2: or more), minimizer twice in it, a crowd of texts


def _in_order(rows: pd.DataFrame) -> tuple[list[str | None], list[bytes]]:
    """A chunk's ids and texts by id and text: shuffles bring rows in any order, and runs name texts by number."""
    pairs = sorted(zip(rows["doc_id"], rows["raw"], strict=True), key=lambda p: (p[0] or "", p[1]))
    return [i for i, _ in pairs], [t for _, t in pairs]


def _info(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """A chunk's runs and the status of its entries."""
    *state, sent = _unpack(rows.loc[rows["kind"] == "runs", "blob"].iat[0], *_STATE)
    parts = rows[rows["kind"] == "status"].sort_values("bucket")["blob"]
    return state, np.frombuffer(b"".join(parts), np.uint8)[sent]


def _spread_windows(texts: list[bytes], state: list[np.ndarray], status: np.ndarray, rep: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct window hashes of the entries that are spread, their counts (2: or more), each window's place among them, and the entries."""
    text, first, last, _, _, many = state
    entries = np.flatnonzero(status == SPREAD).tolist()
    flat = [mix(window_hashes(np.frombuffer(texts[text[rep[e]]], np.uint8)[first[rep[e]] : last[rep[e]] + width], width)) for e in entries]
    add = [np.full(len(h), 1 + many[e], np.int64) for e, h in zip(entries, flat, strict=True)]
    keys, at = np.unique(np.concatenate(flat), return_inverse=True) if flat else (np.empty(0, np.uint64), np.empty(0, np.int64))
    counts = np.bincount(at, weights=np.concatenate(add), minlength=len(keys)).astype(np.int64) if flat else np.empty(0, np.int64)
    return keys, np.minimum(counts, 2), at, entries


def find_repeats(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, with_kept: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bytes of each document that belong to a string of ``width`` bytes which starts anywhere else too, the same document included.

    Returns ``doc_id, n_bytes, n_removed, span_starts, span_ends, kept_sha256`` (and ``kept``, binary, if asked for), one row per input
    row. Spans are the maximal removed runs, in bytes of the text's UTF-8; strings are judged on the input, so every copy goes. Null
    texts are empty; texts shorter than ``width`` keep everything; repeated rows are copies of each other; very long texts are hashed
    in overlapping pieces. An empty table gives an empty result; extra columns are ignored, whatever their names.

    A merging task holds the transforms of one bucket: at most HOT texts of one minimizer, each of less than ``2 * width - GRAM`` bytes
    unless the text has a long period (a period's run is one text). Windows of a minimizer with more texts are compared exactly too,
    by their hashes, which spread over all buckets: no group of one minimizer, however large, meets in one task.
    """
    ship(docs.sparkSession)
    total = text_bytes(docs, text_col)
    bits = bucket_bits(total / 150, RUNS)
    merge_bits = bucket_bits(total * 0.35, MERGED)
    parts = in_chunks(docs, id_col, text_col, total, CHUNK_BYTES)

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        r = Runs(_in_order(rows)[1], width)
        named = mix(r.key)  # a minimizer is the smallest of many hashes, so its own top bits are nearly always 0
        order = np.lexsort((r.hash, named))
        key, whole = named[order], r.hash[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
        entry = np.empty(len(key), np.int64)
        entry[order] = np.cumsum(new) - 1
        key, whole = key[new], whole[new]
        many = np.minimum(np.bincount(entry, minlength=len(key)), 2)
        twice = np.bincount(entry, weights=r.twice, minlength=len(key)) > 0
        chunk = int(rows["chunk"].iat[0])
        _, of_key, texts = np.unique(key, return_inverse=True, return_counts=True)
        crowd = texts[of_key] > CROWD
        lead = np.ones(len(key), bool)
        lead[1:] = ~crowd[1:] | (key[1:] != key[:-1])  # of a crowd the first entry stands for all
        sent = np.cumsum(lead) - 1
        out = [(chunk, -1, "runs", _pack(r.text.astype("i4"), r.first, r.last, entry.astype("i4"), key, (many > 1).astype("u1"), sent.astype("i4")))]
        key, whole, many, twice, crowd = (x[lead] for x in (key, whole, many, twice, crowd))
        for b, own in bucket_slices(key, bits):
            out.append((chunk, b, "entries", _pack(key[own], whole[own], many[own].astype("u1"), twice[own].astype("u1"), crowd[own].astype("u1"))))
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "blob"])

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        opened = [_unpack(b, *_ENTRY) for b in rows["blob"]]
        key, whole, many, twice, crowd = (np.concatenate([o[i] for o in opened]) for i in range(5))
        order = np.lexsort((whole, key))
        k, w = key[order], whole[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        other = first.copy()
        other[1:] |= w[1:] != w[:-1]
        group = np.cumsum(first) - 1
        n = int(group[-1]) + 1
        count = np.bincount(group, weights=many[order], minlength=n)
        texts = np.bincount(group, weights=np.where(crowd[order] > 0, HOT + 1, other), minlength=n)
        again = np.bincount(group, weights=twice[order], minlength=n) > 0
        verdict = np.where(again | (texts > 1), np.where(texts > HOT, SPREAD, MIXED), np.where(count > 1, SETTLED, UNIQUE)).astype(np.uint8)
        status = np.empty(len(k), np.uint8)
        status[order] = verdict[group]
        ends = np.cumsum([len(o[0]) for o in opened])
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "kind": "status", "blob": [p.tobytes() for p in np.split(status, ends[:-1])]})

    def gather(rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        texts = _in_order(rows)[1]
        state, status = _info(info)
        text, first, last, entry, key, many = state
        rep = np.unique(entry, return_index=True)[1]
        chunk, out = int(info["chunk"].iat[0]), []
        own = np.flatnonzero(status == MIXED)
        bucket = (key[own] >> np.uint64(64 - merge_bits)).astype(np.int64)
        for b in np.unique(bucket):
            e = own[bucket == b]
            strings = [texts[text[i]][first[i] : last[i] + width] for i in rep[e]]
            out.append((chunk, int(b), "texts", _pack(e.astype("i4"), many[e], np.array([len(t) for t in strings], "i8"), np.frombuffer(b"".join(strings), "u1"))))
        hashes, counts, _, _ = _spread_windows(texts, state, status, rep, width)
        for b, part in bucket_slices(hashes, merge_bits):
            out.append((chunk, b, "windows", _pack(hashes[part], counts[part].astype("u1"))))
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "blob"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if rows["kind"].iat[0] == "texts":
            shards, entries = [], []
            for blob in rows["blob"]:
                e, many, sizes, data = _unpack(blob, "i4", "u1", "i8", "u1")
                raw, ends = data.tobytes(), np.cumsum(sizes)
                shards.append(([raw[z - s : z] for s, z in zip(sizes, ends, strict=True)], many))
                entries.append(e)
            for chunk, bucket, e, flags in zip(rows["chunk"], rows["bucket"], entries, repeated_starts(shards, width, block), strict=True):
                spans = [_intervals(f) for f in flags]
                owner = np.repeat(e, [len(s[0]) for s in spans]).astype("i4")
                lo, hi = (np.concatenate([s[i] for s in spans]).astype("i8") for i in (0, 1))
                out.append((chunk, bucket, "spans", _pack(owner, lo, hi)))
        else:
            opened = [_unpack(b, "u8", "u1") for b in rows["blob"]]
            flat, add = np.concatenate([o[0] for o in opened]), np.concatenate([o[1] for o in opened])
            _, at = np.unique(flat, return_inverse=True)
            several = (np.bincount(at, weights=add) >= 2).astype(np.uint8)[at]
            ends = np.cumsum([len(o[0]) for o in opened])
            out = [(c, b, "several", p.tobytes()) for c, b, p in zip(rows["chunk"], rows["bucket"], np.split(several, ends[:-1]), strict=True)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "blob"])

    def finish(rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _in_order(rows)
        if not texts:
            return pd.DataFrame(columns=names)
        state, status = _info(info)
        text, first, last, entry, _, _ = state
        buf, begins = joined(texts)
        edge = np.zeros(len(buf) + 1, np.int32)

        def cover(starts: np.ndarray, stops: np.ndarray) -> None:
            np.add.at(edge, starts, 1)
            np.add.at(edge, stops, -1)

        base = begins[text] + first
        sure = status[entry] == SETTLED if len(entry) else np.empty(0, bool)
        cover(base[sure], begins[text[sure]] + last[sure] + width)
        found = [_unpack(b, "i4", "i8", "i8") for b in info.loc[info["kind"] == "spans", "blob"]]
        rep = np.unique(entry, return_index=True)[1]
        _, _, at, spread = _spread_windows(texts, state, status, rep, width)
        if spread:
            several = np.frombuffer(b"".join(info[info["kind"] == "several"].sort_values("bucket")["blob"]), np.uint8)[at].astype(bool)
            done = 0
            for e in spread:
                n = int(last[rep[e]] - first[rep[e]]) + 1
                lo, hi = _intervals(several[done : done + n])
                found.append([np.full(len(lo), e, "i4"), lo, hi])
                done += n
        if found:
            owner, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(3))
            by = np.argsort(owner, kind="stable")
            owner, lo, hi = owner[by], lo[by], hi[by]
            begin, end = np.searchsorted(owner, entry, side="left"), np.searchsorted(owner, entry, side="right")
            own = np.repeat(np.arange(len(entry)), end - begin)
            which = np.arange(len(own)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
            cover(base[own] + lo[which], base[own] + hi[which] - 1 + width)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, t in enumerate(texts):
            flags = gone[begins[i] : begins[i] + len(t)]
            lo, hi = _intervals(flags)
            kept = np.frombuffer(t, np.uint8)[~flags].tobytes() if len(lo) else t
            out.append((ids[i], len(t), int(flags.sum()), lo, hi, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_kept else ()))
        return pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_bytes", "n_removed", "span_starts", "span_ends", "kept_sha256"] + ["kept"] * with_kept
    schema = "chunk int, bucket int, kind string, blob binary"
    first_pass = keep(parts.groupBy("chunk").applyInPandas(runs, schema), "runs")
    judged = keep(first_pass.where("kind = 'entries'").groupBy("bucket").applyInPandas(judge, schema), "judged")
    known = first_pass.where("kind = 'runs'").unionByName(judged)
    sent = parts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(gather, schema)
    compared = sent.groupBy("kind", "bucket").applyInPandas(compare, schema)
    result = "doc_id string, n_bytes long, n_removed long, span_starts array<bigint>, span_ends array<bigint>, kept_sha256 string" + ", kept binary" * with_kept
    done = parts.groupBy("chunk").cogroup(known.unionByName(compared).groupBy("chunk")).applyInPandas(finish, result)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
