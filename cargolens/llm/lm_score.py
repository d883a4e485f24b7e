"""Masked pseudo-likelihood scores by a bidirectional window network.

The network predicts each token of a public byte-level vocabulary from the two tokens on each side of it: embeddings, weighed by place
and added up, are squashed, and a softmax over all tokens is taken down a Huffman tree of their counts: a token's probability is the
product of the turns on its path, so that the probabilities of all tokens add up to 1. Counts over the whole corpus shape the tree and
start its turns at the tokens' shares. Training masks every place of every document once; each round, tasks run numpy over their part
of that round's documents, and their weights are averaged, by tokens seen, in a shuffle. There are more rounds the more text there is
(see rounds_of). A document's score is the sum of its tokens' conditional log-probabilities, over all places.

What goes to the driver is the counts and one set of weights for each round: as many rows as the vocabulary has tokens, however large the
corpus. Documents are encoded once, into a written table of ids.

Defined results: a text without tokens (null, empty) has sum 0 and a null mean. Texts of any length are scored whole. Rows are never
merged or dropped; repeated rows and null or repeated ids each get a score. An empty table gives an empty result. Other columns are kept,
whatever their names, but for text and those with the name of a result column.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import ship, table, with_fields
from cargolens.llm.tokens import WORDS, byte_encoder, slices

#: Network width; tokens on each side; places in a step.
WIDTH, SIDE, STEP = 12, 2, 32_768
RATE = 0.1
#: Turns at inner nodes with at least this share of the corpus are taken as products of matrices.
SHARE = 1 / 256
#: Rounds at least, and the bytes of text beyond which each doubling adds one.
ROUNDS, ROUND_BYTES = 3, 1 << 28


@dataclass
class Tree:
    """A Huffman tree over tokens. nodes[d, t]: the inner node at depth d of token t's path; signs: the turn there; depth: the path's length."""

    nodes: np.ndarray
    signs: np.ndarray
    depth: np.ndarray
    #: The log-odds of turning right at each inner node, by the counts.
    odds: np.ndarray
    #: Tokens with the same turns at frequent nodes form a group; those turns, group by group from starts on: the nodes and the signs.
    group: np.ndarray
    starts: np.ndarray
    upper: np.ndarray
    upper_signs: np.ndarray
    #: How many turns of a token come first at frequent nodes, and how many follow.
    above: np.ndarray
    below: np.ndarray
    #: Tokens' places in an order of most turns below first, and of those with as many with common turns side by side.
    rank: np.ndarray


def tree_of(counts: np.ndarray, share: float = SHARE) -> Tree:
    """Counts are smoothed by one, so that every token has a path. Ties go by number. share: of the corpus, from which on a node is frequent."""
    n = len(counts)
    weight = [int(c) + 1 for c in counts]
    heap = [(w, t) for t, w in enumerate(weight)]
    heapq.heapify(heap)
    parent, right = [0] * (2 * n - 1), [False] * (2 * n - 1)
    weight += [0] * (n - 1)
    odds = np.zeros(max(n - 1, 1), np.float32)
    for k in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = k
        right[y] = True
        odds[k - n] = np.log(b / a)
        weight[k] = a + b
        heapq.heappush(heap, (a + b, k))
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    most = max(depth[:n])
    nodes, signs = np.zeros((most, n), np.int32), np.zeros((most, n), np.float32)
    for t in range(n):
        k = t
        for d in range(depth[t] - 1, -1, -1):
            nodes[d, t], signs[d, t] = parent[k] - n, 1.0 if right[k] else -1.0
            k = parent[k]
    depths = np.array(depth[:n], np.int32)
    heavy = np.array(weight[n:]) >= share * weight[-1]
    above = (heavy[nodes] & (np.arange(most)[:, None] < depths)).sum(axis=0).astype(np.int32)  # no node weighs more than what it hangs from
    tokens = np.arange(n)
    _, first, group = np.unique(2 * nodes[above - 1, tokens] + (signs[above - 1, tokens] > 0), return_index=True, return_inverse=True)
    starts = np.append(0, np.cumsum(above[first]))
    upper, upper_signs = (np.concatenate([x[: above[t], t] for t in first]) for x in (nodes, signs))
    rank = np.empty(n, np.uint16 if n <= 1 << 16 else np.int32)
    rank[np.lexsort([*((nodes * 2 + (signs > 0))[::-1]), above - depths])] = tokens
    return Tree(nodes, signs, depths, odds, group.astype(rank.dtype), starts, upper, upper_signs, above, depths - above, rank)


def start(tree: Tree, width: int = WIDTH) -> np.ndarray:
    """The weights that all tasks of the first round start from: rows of embeddings (one for each token, one for what lies outside a
    text), of inner nodes (last their bias), of weights by place, and the shift."""
    n = len(tree.depth)
    out = np.zeros((n + 1 + len(tree.odds) + 2 * SIDE + 1, width + 1), np.float32)
    out[: n + 1, :width] = np.random.default_rng(0).normal(0, 0.3, (n + 1, width))
    out[n + 1 : n + 1 + len(tree.odds), width] = tree.odds
    out[n + 1 + len(tree.odds) : -1, :width] = 0.5
    return out


def rows_at(array: np.ndarray, i: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """array[i] at a quarter of the time. Places are never out of bounds: "clip" only lets numpy leave out the check and a buffer."""
    return np.take(array, i, axis=0, out=out, mode="clip")


class Network:
    """weights: all rows, see start(); embed, nodes, places and shift are views of them."""

    def __init__(self, weights: np.ndarray, tree: Tree):
        self.tree, self.weights, self.sums = tree, weights, None
        self.rooms: dict[str, np.ndarray] = {}
        n, width = len(tree.depth), weights.shape[1] - 1
        cut = n + 1 + len(tree.odds)
        self.cuts = (n + 1, cut, cut + 2 * SIDE)
        self.embed, self.nodes, self.places, self.shift = weights[: n + 1, :width], weights[n + 1 : cut], weights[cut : cut + 2 * SIDE, :width], weights[-1, :width]

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to be filled, in memory that steps use again: fresh memory costs a fault for each page."""
        size = math.prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, self.weights.dtype)
        return self.rooms[name][:size].reshape(shape)

    def step(self, ids: np.ndarray, at: np.ndarray, learn: bool = False) -> np.ndarray:
        """Log-probabilities of the tokens at some places, in rising order, of a row of ids; learn: train on them, too.

        What lies around is added up for the whole stretch that the places are in; all that has a number for each place has a column for it.
        Places are then sorted by their token's group, whose turns at frequent nodes are a product of two matrices. For the turns that
        follow, nodes are gathered place by place (_lower)."""
        tree, n, width = self.tree, len(at), self.embed.shape[1]
        stretch = ids[at[0] - SIDE : at[-1] + SIDE + 1]
        order = np.argsort(tree.group[ids[at]], kind="stable")
        where = (at - at[0])[order]
        target = ids[at[order]]
        size = len(stretch) - 2 * SIDE
        shifts = [SIDE + d for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]
        places = self.places.T.tolist()
        beside, every, line = self._room("beside", width, len(stretch)), self._room("every", width, size), self._room("line", size)
        beside[:] = rows_at(self.weights, stretch, self._room("rows", len(stretch), width + 1))[:, :width].T
        for x, y, by, shift in zip(beside, every, places, self.shift, strict=True):
            y[:] = shift
            for k, p in zip(shifts, by, strict=True):
                y += np.multiply(x[k : k + size], p, out=line)
        np.tanh(every, out=every)
        h = self._room("h", width + 1, n)
        np.take(every, where, axis=1, mode="clip", out=h[:width])
        h[width] = 1  # for the bias
        most = min(30, 700 / len(tree.nodes))  # bounds 1 / probability for each turn, so that a whole path's can't overflow
        each = np.bincount(tree.group[target], minlength=len(tree.starts) - 1)
        ends, turns = np.cumsum(each), np.diff(tree.starts)
        held = np.append(0, np.cumsum(each * turns)).tolist()
        groups = [(a, z, e - m, e, slice(held[i], held[i + 1])) for i, (a, z, m, e) in enumerate(zip(tree.starts[:-1].tolist(), tree.starts[1:].tolist(), each.tolist(), ends.tolist(), strict=True)) if m]
        paths = self.nodes[tree.upper] * tree.upper_signs[:, None].astype(h.dtype)
        odds, inverse, logs = self._room("odds", held[-1]), self._room("inverse", held[-1]), self._room("logs", n)
        against = -paths
        for a, z, s, e, x in groups:
            np.matmul(against[a:z], h[:, s:e], out=odds[x].reshape(z - a, e - s))
        np.exp(np.minimum(odds, most, out=odds), out=odds)
        np.add(odds, 1, out=inverse)
        if learn:
            odds /= inverse
            back, upper = self._room("back", width, n + 1), np.zeros_like(paths)
            back[:, n] = 0
        np.log(inverse, out=inverse)
        for a, z, s, e, x in groups:
            np.add.reduce(inverse[x].reshape(z - a, e - s), axis=0, out=logs[s:e])
            if learn:
                g = odds[x].reshape(z - a, e - s)
                np.matmul(paths[a:z, :width].T, g, out=back[:, s:e])
                np.matmul(g, h[:, s:e].T, out=upper[a:z])
        low = np.argsort(tree.rank[target], kind="stable")[: np.count_nonzero(tree.below[target])]
        met, slopes = [tree.upper], [(upper * tree.upper_signs[:, None]).T] if learn else []
        if len(low):
            lower = self._room("lower", len(low), width + 1)
            lower[:] = np.take(h, low, axis=1, mode="clip", out=self._room("across", width + 1, len(low))).T
            more = self._room("more", len(low), width + 1) if learn else None
            logs[low] += self._lower(target[low], lower, most, more, met, slopes)
        if learn:
            if len(low):
                back[:, low] += more[:, :width].T
            column = np.full(size, n)
            column[where] = np.arange(n)
            inner = np.take(back, column, axis=1, mode="clip", out=self._room("inner", width, size))
            for x, y in zip(inner, every, strict=True):
                np.multiply(y, y, out=line)
                x *= np.subtract(1, line, out=line)
            self._learn(*self._slopes(np.concatenate(met), np.concatenate(slopes, axis=1), inner, stretch, beside, shifts, n))
        out = np.empty(n)
        out[order] = -logs
        return out

    def _lower(self, target: np.ndarray, h: np.ndarray, most: float, back: np.ndarray | None, met: list[np.ndarray], slopes: list[np.ndarray]) -> np.ndarray:
        """Sums of -log probability over the turns at nodes that aren't frequent; back, met and slopes, if given, take what training needs.

        Places come in the order of their tokens' rank: those that still turn come first, those that turn at the same node are side by side."""
        tree, n = self.tree, len(target)
        below = tree.below[target]
        turning = n - np.searchsorted(below[::-1], np.arange(below[0]), "right")
        path = tree.above[target].astype(np.int64) * len(tree.depth) + target
        nodes, signs = tree.nodes.reshape(-1), tree.signs.reshape(-1)
        rows, products = self._room("rows", *h.shape), self._room("products", *h.shape)
        turns, ones, across = np.ones(n), np.ones(h.shape[1], h.dtype), self._room("across", h.shape[1], n)
        if back is not None:
            back[:] = 0
            across[:] = h.T
        for d, m in enumerate(turning.tolist()):
            i = path[:m] + d * len(tree.depth)
            node, sign = rows_at(nodes, i), rows_at(signs, i)
            turn = rows_at(self.nodes, node, rows[:m])
            e = np.multiply(turn, h[:m], out=products[:m]) @ ones
            e *= -sign
            np.exp(np.minimum(e, most, out=e), out=e)
            turns[:m] *= 1 + e
            if back is not None:
                g = sign * e / (1 + e)
                turn *= g[:, None]
                back[:m] += turn
                runs = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1)
                met.append(node[runs])
                slopes.append(np.add.reduceat(g * across[:, :m], runs, axis=1))
        return np.log(turns)

    def _slopes(self, met: np.ndarray, slopes: np.ndarray, inner: np.ndarray, stretch: np.ndarray, beside: np.ndarray, shifts: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of weights that n places move, and their gradients: of nodes from sums over runs, of embeddings from what all places around give."""
        a, b, c = self.cuts
        width, size = inner.shape
        outer, line = self._room("outer", width, len(stretch)), self._room("line", size)
        outer[:] = 0
        moved = np.zeros((2 * SIDE + 1, width + 1))
        for j, (x, y, o, by) in enumerate(zip(inner, beside, outer, self.places.T.tolist(), strict=True)):
            for i, (k, p) in enumerate(zip(shifts, by, strict=True)):
                o[k : k + size] += np.multiply(x, p, out=line)
                moved[i, j] = x @ y[k : k + size]
            moved[-1, j] = x.sum()
        which, values = [], []
        for first, i, v in ((0, stretch, outer), (a, met, slopes)):
            seen = np.flatnonzero(np.bincount(i))
            slot = np.empty(seen[-1] + 1, np.int64)
            slot[seen] = np.arange(len(seen))
            i = slot[i]
            which.append(seen + first)
            sums = np.zeros((len(seen), width + 1))
            for j, x in enumerate(v):
                sums[:, j] = np.bincount(i, weights=x, minlength=len(seen))
            values.append(sums)
        which.append(np.arange(b, c + 1))
        values.append(moved)
        return np.concatenate(which), (np.concatenate(values) / n).astype(self.weights.dtype)

    def gradient(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of the mean log-probability, by row of weights."""
        g = np.zeros_like(self.weights)
        g[which] = values
        return g

    def _learn(self, which: np.ndarray, g: np.ndarray) -> None:
        """A step of AdaGrad; rows without a gradient stay as they are."""
        if self.sums is None:
            self.sums = np.full_like(self.weights, 1e-4)
        sums = self.sums[which] + np.square(g)
        self.sums[which] = sums
        self.weights[which] += RATE * g / np.sqrt(sums)


def joined(rows: list[bytes], edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all rows with SIDE edges around each, the places of their tokens, and how many each row has."""
    n = np.array([len(r) // 2 for r in rows], np.int64)
    places = np.repeat((2 * np.arange(len(n)) + 1) * SIDE, n)
    places += np.arange(len(places))
    ids = np.full(len(places) + 2 * SIDE * len(n), edge, np.int32)
    ids[places] = np.frombuffer(b"".join(rows), "<u2")
    return ids, places, n


def rounds_of(n_bytes: int) -> int:
    return ROUNDS + (n_bytes // ROUND_BYTES).bit_length()


def encoded(documents: DataFrame, path: str, ranks: str, rounds: int) -> DataFrame:
    """(row, part, ids) as a written table: the rows' own columns but text as a struct, the round that trains on them, and 16-bit ids."""
    ship(documents.sparkSession)
    keep = [c for c in documents.columns if c.lower() not in ("text", "n_tokens", "log_likelihood", "mean_log_likelihood")]
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct(*keep).alias("row"), F.pmod(F.xxhash64(text), F.lit(rounds)).cast("int").alias("part"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_encoder(path, ranks)
        for b in slices(batches, "text", chars=WORDS):
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, enc.rows(b.column("text"))], names=["row", "part", "ids"])

    return table(rows.mapInArrow(run, with_fields(rows.drop("text"), "ids binary")), "token-ids")


def counts_of(ids: DataFrame, size: int) -> np.ndarray:
    """How often each token stands in the corpus."""
    ship(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in slices(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["token", "n"])

    found = ids.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["token"].to_numpy()] = found["n"].to_numpy()
    return out


def train(ids: DataFrame, tree: Tree, rounds: int, width: int = WIDTH) -> np.ndarray:
    """Weights after all rounds: each document trains in the round of its part, every one of its places once."""
    spark = ids.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tree)
    weights, edge = start(tree, width), len(tree.depth)
    names = [f"v{j}" for j in range(width + 1)]
    for k in range(rounds):
        before = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], before=before) -> Iterator[pa.RecordBatch]:
            net, seen = Network(before.value.copy(), shared.value), 0
            for b in slices(batches, "ids"):
                row_ids, places, _ = joined(b.column("ids").to_pylist(), edge)
                for a in range(0, len(places), STEP):
                    net.step(row_ids, places[a : a + STEP], learn=True)
                seen += len(places)
            moved = np.flatnonzero((net.weights != before.value).any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), pa.array(np.full(len(moved), float(seen))), *(pa.array(net.weights[moved, j]) for j in range(width + 1))], names=["i", "seen", *names])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(seen)]), *(pa.array([0.0], pa.float32()) for _ in names)], names=["i", "seen", *names])

        made = ids.where(F.col("part") == k).select("ids").mapInArrow(run, "i int, seen double, " + ", ".join(f"{v} float" for v in names))
        got = made.groupBy("i").agg(F.sum("seen").alias("seen"), *(F.sum(F.col(v) * F.col("seen")).alias(v) for v in names)).toArrow()
        i, seen = got["i"].to_numpy(), got["seen"].to_numpy()
        total, rows = seen[i < 0].sum(), i >= 0
        if total:  # rows that a task left as they were count with what they were
            new = np.stack([got[v].to_numpy()[rows] for v in names], axis=1) + (total - seen[rows])[:, None] * weights[i[rows]]
            weights = weights.copy()
            weights[i[rows]] = new / total
        before.unpersist()
    return weights


def score(ids: DataFrame, tree: Tree, weights: np.ndarray) -> DataFrame:
    """The rows of encoded documents, with n_tokens, log_likelihood (sum) and mean_log_likelihood."""
    spark = ids.sparkSession
    ship(spark)
    shared, edge = spark.sparkContext.broadcast((tree, weights)), len(tree.depth)
    rows = ids.select("row", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value[1], shared.value[0])
        for b in slices(batches, "ids"):
            row_ids, places, n = joined(b.column("ids").to_pylist(), edge)
            logs = np.concatenate([np.zeros(0), *(net.step(row_ids, places[a : a + STEP]) for a in range(0, len(places), STEP))])
            upto = np.append(0.0, np.cumsum(logs))[np.append(0, np.cumsum(n))]
            total = np.diff(upto)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n), pa.array(total), mean], names=["row", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return rows.mapInArrow(run, with_fields(rows.drop("ids"), "n_tokens long, log_likelihood double, mean_log_likelihood double")).select("row.*", "n_tokens", "log_likelihood", "mean_log_likelihood")


def scored(documents: DataFrame) -> DataFrame:
    """Rows of documents without text, scored by a network that learns from all of them."""
    import public_tokenizers as public

    path, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
    rounds = rounds_of(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    ids = encoded(documents, path, ranks, rounds)
    tree = tree_of(counts_of(ids, byte_encoder(path, ranks).size))
    return score(ids, tree, train(ids, tree, rounds))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
