"""Packing token sequences by a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence. Multiplicative weights price the lengths by how little of each is
covered so far, a knapsack dynamic program finds the configurations of the highest price, one around each length that lags, and each
is used as often as whole sequences of it can be filled. A program covers all but REST of the tokens; best fit places those. Lengths that
ended up in badly filled sequences are priced higher in the next program, until the lower bound is met. All of it works on counts per
length, so its cost depends on the capacity and not on the number of pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.llm.hashing import LOWER, batches_of, joined, word_hashes
from spreadgraph.operators.numbering import number_within
from spreadgraph.storage import keep, ship

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Words whose ids a worker remembers (about 35 bytes each); all are forgotten beyond it.
REMEMBERED = 3_000_000
#: Bytes of text encoded at once.
AT_ONCE = 3 << 20
#: Programs at most, each with prices corrected by the one before; the best plan counts.
PROGRAMS = 6
#: Lengths around which one pricing step looks for configurations.
LAGGING = 64
#: Share of the tokens that a program leaves to best fit.
REST = 1 / 256

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


#: ASCII marks that end a run of letters and that a run of letters ends: never inside a piece with one.
_MARKS = b"!\"#$%&()*+,-./:;=?@[]^_`{}~"
_KIND = np.full(256, 3, np.int8)  # 0 white space, 1 ASCII letters, 2 marks, 3 whatever may stand in a piece with any of them
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[list(_MARKS)] = 2


class WordEncoder:
    """Ids of whole texts, word by word: the tokenizer splits at white space, so a text's ids are its words' ids in a row.

    Here a word also ends where ASCII letters and marks meet, which the tokenizer never joins either. The words of a batch are hashed
    and looked up at once; new ones are encoded together, as one text whose tokens' offsets say which word they belong to. A
    tokenizer that splits otherwise (checked at the start) gets whole texts. Words are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe, marks = "abcdefghijklmnopqrstuvwxyz", _MARKS.decode()
        pieces = lambda t: [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(t))]
        self.by_word = pieces(f"{probe.upper()}  {probe[::-1]}") == [probe, probe[::-1]] and all(pieces(f"{probe}{m}{probe}") == [probe, m, probe] for m in [*marks, marks])
        self.forget()

    def forget(self) -> None:
        self.hash, self.begin, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)  # ascending by hash
        self.ids = np.empty(0, "<u4")

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode new words (ascending hashes) and remember their ids."""
        texts = [w.decode() for w in words]
        code = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        starts = np.fromiter((o[0] for o in code.offsets), np.int64, len(code.offsets))
        bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        at = np.searchsorted(self.hash, hashes)
        self.begin = np.insert(self.begin, at, len(self.ids) + bounds[:-1])
        self.length = np.insert(self.length, at, np.diff(bounds))
        self.hash = np.insert(self.hash, at, hashes)
        self.ids = np.concatenate((self.ids, np.array(code.ids, "<u4")))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8), as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4") for t in texts]
        if len(self.hash) > REMEMBERED:
            self.forget()
        raw, begins = joined(texts)
        buf = LOWER[raw]
        kind = np.zeros(len(buf) + 2, np.int8)
        kind[1:-1] = _KIND[buf]
        here, edge = kind[1:-1] != 0, kind[1:] * kind[:-1]
        edge = (edge == 0) | (edge == 2)  # between a place and the one before it
        starts, ends = np.flatnonzero(here & edge[:-1]), np.flatnonzero(here & edge[1:]) + 1
        hashes, one, word = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != hashes[inside]
        if new.any():
            data = buf.tobytes()
            self.learn(hashes[new], [data[i:j] for i, j in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hash, hashes)
        lengths = self.length[at][word]
        last = np.cumsum(lengths)
        flat = self.ids[np.arange(int(last[-1]) if len(last) else 0) + np.repeat(self.begin[at][word] - (last - lengths), lengths)]
        cuts = np.concatenate(([0], last))[np.searchsorted(starts, begins)]
        return [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return WordEncoder(path)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, array of int, if asked for): each document's ids, then one end id, cut at the capacity."""
    size = 4 * capacity

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer_path)
        for b in batches:
            texts = [t or b"" for t in b["_raw"]]
            rows = []
            coded = chain.from_iterable(encode(texts[part]) for part in batches_of([len(t) for t in texts], AT_ONCE))
            for doc_id, ids in zip(b["doc_id"], coded, strict=True):
                whole = ids.tobytes() + END_ID.to_bytes(4, "little")
                for k in range(0, len(whole), size):
                    part = whole[k : k + size]
                    rows.append((doc_id, k // size, k // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    # ids pass through pandas as text: with a null among them it would make long integers floats
    made = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("_raw")).mapInPandas(pieces, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


class Knapsack:
    """The multisets of lengths of the highest total price for every capacity up to one, each length at most ``most`` times.

    Counts are split into powers of two, so a length is a few items of a dynamic program over 0 or 1 of each. One bit an item and
    capacity says whether the item was taken.
    """

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int):
        item, times = [], []
        for i, (x, m) in enumerate(zip(lengths.tolist(), most.tolist(), strict=True)):
            left, k = min(int(m), capacity // x), 1
            while left > 0:
                k = min(k, left)
                item.append(i)
                times.append(k)
                left, k = left - k, 2 * k
        self.lengths, self.item, self.times = lengths, item, times
        self.taken = np.zeros((len(item), capacity // 8 + 1), np.uint8)
        best, flag = np.zeros(capacity + 1), np.empty(capacity + 1, bool)
        for j, (i, k) in enumerate(zip(item, times, strict=True)):
            size = int(lengths[i]) * k
            with_item, without = best[:-size] + prices[i] * k, best[size:]
            flag[:size] = False
            np.greater(with_item, without, out=flag[size:])
            np.copyto(without, with_item, where=flag[size:])
            self.taken[j] = np.packbits(flag)

    def config(self, capacity: int) -> Counter:
        out: Counter = Counter()
        j = len(self.item)
        while (at := np.flatnonzero(self.taken[:j, capacity >> 3] & (128 >> (capacity & 7)))).size:
            j = int(at[-1])
            x, k = int(self.lengths[self.item[j]]), self.times[j]
            out[x] += k
            capacity -= x * k
        return out


def best_config(prices: np.ndarray, lengths: np.ndarray, capacity: int, table: Knapsack | None = None) -> Counter:
    """The multiset of lengths of the highest total price within the capacity, read from a table of the same prices if one is given."""
    return (table or Knapsack(prices, lengths, capacity // lengths, capacity)).config(capacity)


def fractional(demand: dict[int, int], capacity: int, worth: np.ndarray | None = None, rate: float = 0.1) -> dict[Config, int]:
    """Multiplicative weights for: as few sequences as can be, each length covered as often as demanded.

    ``worth`` is the price of a token of each length, ascending (1 if not given). A length's price falls with the share of its demand
    covered so far. Each step completes the LAGGING least covered lengths, longest first, to their best configurations and uses each
    of these until the scarcest of its lengths is gone, a whole number of times. No length is covered beyond its demand, and
    all but REST of the tokens are covered.
    """
    lengths = np.array(sorted(demand))
    need = np.array([demand[x] for x in lengths.tolist()])
    value = lengths * (np.ones(len(lengths)) if worth is None else worth)
    at = {x: i for i, x in enumerate(lengths.tolist())}
    left, used = need.copy(), Counter()
    while (lengths * left).sum() > REST * (lengths * need).sum():
        live = np.flatnonzero(left)
        done = 1 - left[live] / need[live]
        prices = value[live] * np.exp(-rate * (done - done.min()))
        table = Knapsack(prices, lengths[live], left[live], capacity)
        covered = False
        lagging = live[np.lexsort((-lengths[live], done))[:LAGGING]]
        for i in (*lagging.tolist(), None):
            if i is None and covered:
                break
            # the best configuration around a length, or of all if this step's others ran out of pieces
            config = best_config(prices, lengths[live], capacity - (0 if i is None else int(lengths[i])), table)
            if i is not None:
                config[int(lengths[i])] += 1
            own, many = np.array([at[x] for x in config]), np.array(list(config.values()))
            if whole := int((left[own] // many).min()):
                left[own] -= whole * many
                used[tuple(sorted(config.items(), reverse=True))] += whole
                covered = True
    return dict(used)


def best_fit(demand: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit decreasing on counts: alike sequences are one group, so the cost doesn't depend on how many pieces there are."""
    groups: dict[tuple[int, Config], int] = {}
    for length in sorted(demand, reverse=True):
        left = demand[length]
        for space, config in sorted(g for g in groups if g[0] >= length):
            if not left:
                break
            n = groups[space, config]
            each = space // length
            whole, rest = divmod(left, each) if left < n * each else (n, 0)
            for count, k in ((whole, each), (1, rest)):
                if count and k:
                    groups[space, config] -= count
                    key = (space - k * length, (*config, (length, k)))
                    groups[key] = groups.get(key, 0) + count
                    left -= count * k
            if not groups[space, config]:
                del groups[space, config]
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            for count, k in ((whole, each), (1, rest)):
                if count and k:
                    key = (capacity - k * length, ((length, k),))
                    groups[key] = groups.get(key, 0) + count
    return [(config, n) for (_, config), n in groups.items()]


def solve(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Configurations and how often each is used; together they hold exactly the demanded pieces."""
    left = {int(x): int(n) for x, n in demand.items() if n > 0}
    out: Counter = Counter()
    if capacity in left:
        out[((capacity, 1),)] += left.pop(capacity)
    lengths = np.array(sorted(left))
    worth, bound = np.ones(len(lengths)), -(-sum(x * n for x, n in left.items()) // capacity)
    at = {x: i for i, x in enumerate(lengths.tolist())}
    best: Counter | None = None
    for _ in range(PROGRAMS if left else 0):
        plan, rest = Counter(fractional(left, capacity, worth)), dict(left)
        for config, n in plan.items():
            for x, k in config:
                rest[x] -= n * k
        for config, n in best_fit({x: n for x, n in rest.items() if n}, capacity):
            plan[config] += n
        if best is None or plan.total() < best.total():
            best = plan
        if best.total() <= bound:
            break
        cost = np.zeros(len(lengths))  # of a length's tokens: what its sequences would hold if full, to what they hold
        for config, n in plan.items():
            full = capacity / sum(x * k for x, k in config)
            for x, k in config:
                cost[at[x]] += n * k * full / left[x]
        worth = (worth + cost) / 2
    out.update(best or {})
    return sorted(out.items())


def _places(plan: list[tuple[Config, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: where each configuration's share of the pieces begins, its pieces a sequence, first sequence, offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    dealt: Counter = Counter()
    sequence = 0
    for config, n in plan:
        offset = 0
        for length, k in config:
            out.setdefault(length, []).append((dealt[length], k, sequence, offset))
            dealt[length] += n * k
            offset += length * k
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to a table of pieces that ``keep`` returned. Only a histogram of at most ``capacity`` bins reaches the driver."""
    spark = pieces.sparkSession
    demand = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_places(solve(demand, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for x in np.unique(lengths):
            own = lengths == x
            begin, k, first, base = shared.value[int(x)]
            i = np.searchsorted(begin, ranks[own], side="right") - 1
            r = ranks[own] - begin[i]
            seq[own], off[own] = first[i] + r // k[i], base[i] + r % k[i] * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = number_within(pieces, "length", "_rank_in_length")
    return ranked.withColumn("_spot", spot("length", "_rank_in_length")).select("*", "_spot.sequence_id", "_spot.offset").drop("_spot", "_rank_in_length")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their place in a sequence.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for). A null or empty text is the end
    id alone; longer documents than the capacity are cut, none is dropped, however long; repeated rows are packed each. Pieces of one
    length are alike to the plan: which of them goes where follows their order in the files. An empty table gives an empty result;
    extra columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    out = place(keep(token_pieces(docs, capacity, tokenizer_path, with_ids, id_col, text_col), "pieces"), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
