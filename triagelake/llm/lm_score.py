"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

Words (ASCII lower-cased, split at ASCII white space) become the subword ids of a public byte-level
BPE, one ``end`` closes a text. One attention layer over a window predicts the class of the next id
in two steps, a group and a class in it (``GROUPS`` x ``SIZE`` bins of equal frequency mass); the id
within its class is predicted by its counts in the corpus: after the id before it in the word,
smoothed with its share of the class (a word's first id has only that share). What lies within
classes depends on the word alone and is kept by word (``insides``). A word's probability is the mean
(weight ``UNIGRAM``) of what the ids say and of the word's share of all training tokens.

Nothing is learnt from a sample. Counts of words, ids and pairs of ids come from all training
documents. The weights are fitted on every window of every training document, each target once and
in the context in which it would be scored: texts are dealt by hash, in pieces, over ``ROUNDS`` and
in each over shards of about ``SHARD`` ids; each shard goes on from the weights of the round by
itself and the results are averaged by targets. Shards are sorted, so the fit does not depend on
partitioning but for the order of float sums.
Windows of ``WINDOW`` ids overlap by ``OVERLAP``; each token is scored once, in the first window
that holds it, with batched masked attention.

Frequent words and pairs (at most ``HEAD`` and ``PAIRS`` of them, exact bounds) are broadcast; what
is left of either is added by an exact join on the word or the pair, so no count is cut.

Defined cases: null text is the empty text (just ``end``); a null id is not held out and not
learnt from; with nothing to learn from all words are unknown and ids are uniform; repeated rows
are scored one by one; whole texts of any length are used; columns that bear a new column's name
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, crc_of_id, prepare, read, save, scratch

WINDOW, OVERLAP, WIDTH = 16, 4, 16
GROUPS, SIZE = 16, 16
CLASSES = GROUPS * SIZE
#: Mass of an id in the making of classes is its count to this power.
POWER = 0.85
#: Most words and pairs of ids in the broadcast tables; the rest is joined.
HEAD, PAIRS = 400_000, 2_000_000
#: Rounds of the fit with their rates, ids in a shard, targets in a piece of a text and windows in a step.
ROUNDS, SHARD, PIECE, BATCH = (0.01, 0.008, 0.006, 0.004, 0.002, 0.001), 1 << 19, 64 * (WINDOW - OVERLAP), 512
#: Weight of a word's share of all tokens in its probability.
UNIGRAM = 0.5
#: Pseudo-counts that the share of a class weighs against pairs of ids.
PSEUDO = 5.0
IDS, END_ID = 50257, 50256
END = b"\n"  # no word holds white space
OTHER_WHITE = re.compile(r"[^\S ]")
_STATE: dict = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Subwords:
    """Subword ids of words, as uint16 bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(IDS, bool)  # which ids begin a word
        self.starts[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.starts[END_ID] = True

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word begins. The words are encoded in one text, as pieces
        never reach over a space; a word that holds other white space is encoded alone."""
        text = (b" " + b" ".join(words)).decode("utf-8", "replace") if words else ""
        if len(words) > 1 and OTHER_WHITE.search(text):
            half = len(words) // 2
            (a, at), (b, later) = self.encode(words[:half]), self.encode(words[half:])
            return np.append(a, b), np.append(at, later + len(a))
        ids = np.array(self.encoding.encode_ordinary(text), np.uint16)
        return ids, np.zeros(1, np.int64) if len(words) == 1 else np.flatnonzero(self.starts[ids])


class Numbers(dict):
    """word -> number of a frequent word; other words are numbered on in ``others``, which each block of documents begins anew."""

    def anew(self) -> dict[bytes, int]:
        self.others = defaultdict(count(len(self)).__next__)
        return self.others

    def __missing__(self, word: bytes) -> int:
        return self.others[word]


def subwords(path: str) -> Subwords:
    import triagelake.llm.lm_score as home  # the worker's own module: its cache outlives a task

    if path not in home._STATE:
        home._STATE[path] = Subwords(path)
    return home._STATE[path]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: ASCII case and white space only


def by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each class, where each group's part begins in order of groups, and that order."""
    group = target // SIZE
    order = np.argsort(group.astype(np.uint8), kind="stable")  # a radix sort
    return group, np.append(0, np.cumsum(np.bincount(group, minlength=GROUPS))).tolist(), order


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a and b by turns."""
    out = np.empty(2 * len(a), np.int64)
    out[::2], out[1::2] = a, b
    return out


def steady(z: np.ndarray) -> np.ndarray:
    """Takes its largest entry off each row, if any entry of z is too large or too small for the exponential."""
    if z.size and not (z.max() < 60 and z.min() > -60):
        z -= z.max(1, keepdims=True)
    return z


def shares(s: np.ndarray) -> np.ndarray:
    """Makes the shares of attention, up to a factor, of their logs."""
    if s.size and not s.max() < 60:
        np.minimum(s, 60.0, out=s)
    return np.exp(s, out=s)


def log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of z (overwritten) at one column of each row."""
    hit = np.take(steady(z), np.arange(0, z.size, z.shape[1]) + at)
    return hit - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _loss(z: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    """Turns logits into the gradient of the weighted log loss by them."""
    np.exp(steady(z), out=z)
    z *= (weight / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + at] -= weight


class Model:
    """X = E[id] + P[place]; H = softmax(causal(X M X')) X, where M stands for the product of query and key projections; the
    value projection is part of what follows. With S = (X, H) the logits of groups are S G + b and of the classes in group k
    S Y[k] + c[k], each plus the log share after the last id, counted in the corpus (``follow``)."""

    def __init__(self, counts: np.ndarray, first: np.ndarray | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        counts = counts.astype(np.float64)
        self.of = np.zeros(IDS, np.int64)
        first = np.zeros(IDS, bool) if first is None else first
        # word beginnings and continuations fill half of the classes each, in order of frequency
        for kind, base in ((first, 0), (~first, CLASSES // 2)):
            order = np.flatnonzero(kind)[np.argsort(-counts[kind], kind="stable")]
            mass = (counts[order] + 0.5) ** POWER
            edge = np.cumsum(mass) - mass / 2
            self.of[order] = base + np.minimum(CLASSES // 2 - 1, edge / max(mass.sum(), 1e-9) * (CLASSES // 2)).astype(np.int64)
        total = np.bincount(self.of, counts + 0.5, CLASSES)
        self.inside = np.log((counts + 0.5) / total[self.of])
        self.prior = np.log(np.maximum(total, 1e-9) / total.sum())
        d = WIDTH
        small = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s).astype(np.float32)
        self.w = {"E": (small(CLASSES, d) * 4)[self.of], "P": small(WINDOW, d) * 0.3, "m": small(d, d) * d**-0.5, "g": small(2 * d, GROUPS) * 0.3, "b": np.zeros(GROUPS, np.float32), "y": small(GROUPS, 2 * d, SIZE) * 0.3, "c": np.zeros((GROUPS, SIZE), np.float32)}
        self.w["m"] = self.w["m"].astype(np.float32)
        self.follow(np.zeros((0, 3), np.int64), np.zeros(CLASSES))
        self.within(np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64))
        self.both: np.ndarray | None = None
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def follow(self, pairs: np.ndarray, starts: np.ndarray, strength: float = 20.0) -> None:
        """pairs: distinct rows (id, class or -1 for a word's end, count); starts: counts of classes that begin a word."""
        i, c, n = pairs.T
        table, ends, last = np.zeros((IDS, CLASSES), np.float32), np.zeros((IDS, 1), np.float32), c < 0
        table[i[~last], c[~last]] = n[~last]
        ends[i[last], 0] = n[last]
        share = (starts / max(1.0, starts.sum())).astype(np.float32)
        prior = (strength * np.exp(self.prior)).astype(np.float32)
        for at in range(0, IDS, 4096):
            table[at : at + 4096] += ends[at : at + 4096] * share + prior
        groups = table.reshape(IDS, GROUPS, SIZE).sum(2)
        self.after_group = np.log(groups / groups.sum(1, keepdims=True))
        for at in range(0, IDS, 4096):
            table[at : at + 4096] /= np.repeat(groups[at : at + 4096], SIZE, 1)
        self.both = None
        self.after = np.log(table, out=table).astype(np.float16).reshape(IDS, GROUPS, SIZE)

    def within(self, pairs: np.ndarray, totals: np.ndarray, rest: bool = False) -> None:
        """pairs: rows (id, id after it in a word, count), from which ids are predicted within their classes; totals: rows
        (id, class, count) of all pairs; rest: whether there are pairs that are not among ``pairs``."""
        i, j, n = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].T
        code = (totals[:, 0] << 16) + totals[:, 1]
        by = np.argsort(code, kind="stable")
        total = np.log(totals[by, 2] + PSEUDO)
        # the last entries are for no hit
        self.class_code, self.rest = np.append(code[by], 1 << 40), np.append(np.log(PSEUDO) - total, 0.0).astype(np.float32)
        got = np.log(n + PSEUDO * np.exp(self.inside[j])) - np.append(total, 0.0)[np.searchsorted(self.class_code, (i << 16) + self.of[j])]
        self.pair_code, self.pair, self.more = np.append((i << 16) + j, 1 << 40), np.append(got, 0.0).astype(np.float32), rest

    def insides(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probability within their classes of the ids of each word (begin: where each word begins); then the
        word and the code of each pair that is not in the table."""
        ids = ids.astype(np.int64)
        out, later = self.inside[ids], np.ones(len(ids), bool)
        later[begin] = False
        at = np.flatnonzero(later)
        i, j = ids[at - 1] << 16, ids[at]
        a, b = np.searchsorted(self.pair_code, i + j), np.searchsorted(self.class_code, i + self.of[j])
        left = np.where(self.class_code[b] == i + self.of[j], self.rest[b], 0.0)
        hit = self.pair_code[a] == i + j
        out[at] = np.where(hit, self.pair[a], left + out[at])
        return np.add.reduceat(out, begin), np.searchsorted(begin, at[~hit], "right") - 1, (i + j)[~hit]

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """Log probabilities of all classes after each place."""
        w = self.w
        x = w["E"][ids] + w["P"]
        s = np.exp(np.minimum(x @ w["m"] @ x.transpose(0, 2, 1) + self.mask, 60.0))
        state = np.concatenate([x, s @ x / s.sum(2, keepdims=True)], 2).reshape(-1, 2 * WIDTH).astype(np.float64)
        norm = lambda z: z - z.max(-1, keepdims=True) - np.log(np.exp(z - z.max(-1, keepdims=True)).sum(-1, keepdims=True))
        groups = norm(state @ w["g"] + w["b"] + self.after_group[ids.ravel()])
        inner = norm(np.einsum("nd,gdk->ngk", state, w["y"]) + w["c"] + self.after[ids.ravel()])
        return (groups[:, :, None] + inner).reshape(-1, CLASSES)

    def freeze(self) -> Model:
        """Makes the tables that scoring reads in place of the weights: what the logits of groups owe to an id or a place
        alone is added up beforehand."""
        w, d = self.w, WIDTH
        self.ready, self.meet, self.place = w["E"], w["m"], w["P"]
        # rows for groups, then rows for classes in each group
        self.by_id = self.after_group + self.ready @ w["g"][:d]
        self.by_turn = np.concatenate([self.place[OVERLAP:] @ w["g"][:d] + w["b"], (np.einsum("sd,gdk->sgk", self.place[OVERLAP:], w["y"][:, :d]) + w["c"]).reshape(-1, SIZE)])
        self.out = np.concatenate([np.broadcast_to(w["g"][d:], (GROUPS, d, GROUPS)), w["y"][:, d:]], 2)
        self.late, self.by_last = w["y"][:, :d], None
        self.w = self.after_group = self.both = None
        self.numbers: Numbers | None = None
        return self

    def widen(self) -> np.ndarray:
        """What logits owe to the last id alone: a row for the groups after each id, then a row for each id and group; made
        where it is read, as it is twice as large as what is sent."""
        if self.by_last is None:
            self.by_last = np.concatenate([self.by_id, self.after.reshape(-1, SIZE)], dtype=np.float32)
            flat, within = np.ascontiguousarray(self.late.transpose(1, 0, 2)).reshape(WIDTH, CLASSES), self.by_last[IDS:]
            for at in range(0, IDS, 4096):
                within[at * GROUPS : (at + 4096) * GROUPS] += (self.ready[at : at + 4096] @ flat).reshape(-1, SIZE)
            self.after = self.by_id = None
        return self.by_last

    def know(self, sub: Subwords, words: list[bytes], counts: np.ndarray, n_ends: int, n_all: int) -> None:
        """A worker's tables of the frequent words, by number: base logs, shares, ids and log probability within classes."""
        self.numbers = Numbers(zip(words, range(len(words))))
        self.logs, self.share, self.end_share = np.log10(counts + 1.0), UNIGRAM / max(1, n_all) * counts, UNIGRAM / max(1, n_all) * n_ends
        self.ids, self.begin, self.own, self.missed, self.missing = self.words(sub, words)

    def words(self, sub: Subwords, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Ids, where each word begins and the last ends, then what ``insides`` says of the words."""
        ids, begin = sub.encode(words)
        none = np.zeros(0, np.int64)
        return ids, np.append(begin, len(ids)), *(self.insides(ids, begin) if words else (np.zeros(0), none, none))

    def block(self, sub: Subwords, texts: list[list[bytes]]) -> tuple:
        """Known words, their summed base logs and the score for each of a block of texts; then the words to be looked up
        (text, place, word, known share, what the ids say) and the pairs to be looked up (text, place, pair)."""
        others, n, head = self.numbers.anew(), len(texts), len(self.numbers)
        sizes = np.array(list(map(len, texts)))
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
        names = list(others)
        ids, begin, inner, missed, missing = self.words(sub, names)
        ids, begin = np.append(self.ids, ids), np.append(self.begin, begin[1:] + len(self.ids))
        whose, known = np.repeat(np.arange(n), sizes), at < head
        found = np.bincount(whose[known], minlength=n)
        base = np.bincount(whose[known], self.logs[at[known]], n)
        long = np.take(begin, at + 1) - np.take(begin, at)
        ends = np.append(0, np.cumsum(long))
        flat = np.take(ids, np.repeat(np.take(begin, at) - ends[:-1], long) + np.arange(ends[-1])).astype(np.int64)
        edge = ends[np.append(0, np.cumsum(sizes))]
        logs = self.score([np.append(flat[a:b], END_ID) for a, b in zip(edge, edge[1:])])
        sums = np.append(0, np.cumsum(logs))
        say = np.take(sums, ends[1:] + whose) - np.take(sums, ends[:-1] + whose) + np.append(self.own, inner)[at]
        share = np.zeros(len(at))
        share[known] = self.share[at[known]]
        mean = lambda share, say: np.log10(share + (1 - UNIGRAM) * np.exp(say))
        total = np.bincount(whose, mean(share, say), n) + mean(self.end_share, logs[edge[1:] + np.arange(n)] + self.inside[END_ID])
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        later, pairs = ~known, (np.zeros(0, np.int64),) * 3
        if self.more:
            missed, missing = np.append(self.missed, missed + head), np.append(self.missing, missing)  # in order of words
            first = np.searchsorted(missed, np.arange(head + len(names) + 1))
            many = np.diff(first)[at]
            pick = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs = (np.repeat(whose, many), np.repeat(place, many), missing[pick])
            later = later | (many > 0)
        back = list(self.numbers) if self.more else []
        words = [names[i - head] if i >= head else back[i] for i in at[later].tolist()]
        return found, base, total, whose[later], place[later], words, share[later], say[later] / np.log(10), *pairs

    def windows(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, then targets and whether to score them for the places from OVERLAP on, and the document of each window."""
        step = WINDOW - OVERLAP
        lengths = np.array([len(d) for d in docs])
        n = -(-lengths // step)
        whose = np.repeat(np.arange(len(docs)), n)
        turn = np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)
        # END stands before a text as its context and after it as padding
        before, after = np.full(OVERLAP + 1, END_ID), np.full(WINDOW, END_ID)
        flat = np.concatenate([part for d in docs for part in (before, d, after)])
        sizes = lengths + len(before) + len(after)
        at = (np.cumsum(sizes) - sizes)[whose][:, None] + (turn * step)[:, None] + np.arange(WINDOW)
        ok = (turn * step)[:, None] + np.arange(step) < lengths[whose][:, None]
        return flat[at], flat[at[:, OVERLAP:] + 1], ok, whose

    def score(self, docs: list[np.ndarray], block: int = 384) -> np.ndarray:
        """Natural log probability of the class of every id of the sequences (each ends with END), in a row."""
        ins, outs, ok, _ = self.windows(docs)
        step, d = WINDOW - OVERLAP, WIDTH
        ones, mask, by_last = np.ones(WINDOW, np.float32), self.mask[OVERLAP:], self.widen()
        got = np.empty((len(ins), step), np.float32)
        turns = np.tile(np.arange(step), min(block, len(ins)))
        for i in range(0, len(ins), block):
            ids = ins[i : i + block]
            x = np.take(self.ready, ids, 0)
            x += self.place
            s = (x[:, OVERLAP:].reshape(-1, d) @ self.meet).reshape(len(ids), step, d) @ x.transpose(0, 2, 1)
            s += mask
            shares(s)
            h = (s @ x).reshape(-1, d)
            h /= (s.reshape(-1, WINDOW) @ ones)[:, None]
            last, target = ids[:, OVERLAP:].ravel(), np.take(self.of, outs[i : i + block].ravel())
            group, edge, order = by_group(target)
            target, group, last, turn = (np.take(a, order) for a in (target, group, last, turns[: len(order)]))
            # the logits of groups, then of the classes in the target's group
            z, state = np.empty((len(order), GROUPS + SIZE), np.float32), np.take(h, order, 0)
            for k in range(GROUPS):
                np.matmul(state[edge[k] : edge[k + 1]], self.out[k], out=z[edge[k] : edge[k + 1]])
            z = z.reshape(-1, SIZE)
            z += np.take(by_last, pairs_of(last, IDS + last * GROUPS + group), 0)
            z += np.take(self.by_turn, pairs_of(turn, step + turn * GROUPS + group), 0)
            hit = np.empty(len(order), np.float32)
            hit[order] = log_share(z, pairs_of(group, target % SIZE)).reshape(-1, 2) @ np.ones(2, np.float32)
            got[i : i + block] = hit.reshape(-1, step)
        return got[ok].astype(np.float64)

    def fit(self, ins: np.ndarray, outs: np.ndarray, ok: np.ndarray | None = None, epochs: int = 1, rate: float = 0.01, batch: int = BATCH) -> None:
        """Adam on the class log loss. ins, outs: windows of ids; ok: which of outs count. Of ids, only those in a step are moved by it."""
        rng = np.random.default_rng(11)
        m = {n: np.zeros_like(a) for n, a in self.w.items()}
        v = {n: np.zeros_like(a) for n, a in self.w.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(ins))
            for i in range(0, len(order), batch):
                t += 1
                pick = order[i : i + batch]
                moved = self.gradients(ins[pick], outs[pick], None if ok is None else ok[pick])
                rows = moved.pop("rows")
                for n, g in moved.items():
                    at = rows if n == "E" else ...
                    a, b = m[n][at], v[n][at]  # of "E" these are copies
                    a += 0.1 * (g - a)
                    g *= g
                    g -= b
                    g *= 0.01
                    b += g
                    if n == "E":
                        m[n][at], v[n][at] = a, b
                    by = np.sqrt(b / (1 - 0.99**t))
                    by += 1e-8
                    self.w[n][at] -= rate * (a / (1 - 0.9**t)) / by

    def gradients(self, ids: np.ndarray, targets: np.ndarray, ok: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss of the targets (those that are ok) of the last places of each window; "E" only for the ids in ``rows``."""
        w, d, step, kind = self.w, WIDTH, targets.shape[1], self.w["E"].dtype
        weight = np.ones(targets.size, kind) if ok is None else ok.ravel().astype(kind)
        weight /= max(1.0, weight.sum())
        if self.both is None or self.both.dtype != kind:  # made here, as what is sent has half the width
            self.both = np.concatenate([self.after_group, self.after.reshape(-1, SIZE)], dtype=kind)
        # for each group the weights of groups, then those of the classes in it; biases stand below, as those of a last entry
        # of the state that is 1
        out = np.concatenate([np.broadcast_to(np.vstack([w["g"], w["b"]]), (GROUPS, 2 * d + 1, GROUPS)), np.concatenate([w["y"], w["c"][:, None]], 1)], 2)
        turned = np.ascontiguousarray(out[:, :-1].transpose(0, 2, 1))
        x = np.take(w["E"], ids, 0)
        x += w["P"]
        late = x[:, WINDOW - step :]
        state = np.empty((len(ids), step, 2 * d + 1), kind)
        state[:, :, :d], state[:, :, 2 * d] = late, 1
        # shares and queries each stand beside what meets them on the way back: [s, ds] and [dh, q]; shares are not divided by
        # their sums, H and dh are
        both, met = np.empty((len(ids), 2 * step, WINDOW), kind), np.empty((len(ids), 2 * step, d), kind)
        ds, dh, q = both[:, step:], met[:, :step], met[:, step:]
        q[:] = (late.reshape(-1, d) @ w["m"]).reshape(q.shape)
        s = q @ x.transpose(0, 2, 1)
        s += self.mask[WINDOW - step :]
        both[:, :step] = shares(s)
        sums = (s.reshape(-1, WINDOW) @ np.ones(WINDOW, kind)).reshape(len(ids), step, 1)
        h = s @ x
        h /= sums
        state[:, :, d : 2 * d] = h
        state = state.reshape(-1, 2 * d + 1)
        before, target = ids[:, WINDOW - step :].ravel().astype(np.int64), np.take(self.of, targets.ravel())  # windows of 16-bit ids would overflow below
        group, edge, order = by_group(target)
        group, target, before = np.take(group, order), np.take(target, order), np.take(before, order)
        sorted_ = np.take(state, order, 0)
        z, g_out, within = np.empty((len(order), GROUPS + SIZE), kind), np.zeros_like(out), np.empty((len(order), 2 * d), kind)
        parts = [(n, slice(edge[n], edge[n + 1])) for n in range(GROUPS) if edge[n + 1] > edge[n]]
        for n, part in parts:
            np.matmul(sorted_[part], out[n], out=z[part])
        rows = z.reshape(-1, SIZE)
        rows += np.take(self.both, pairs_of(before, IDS + before * GROUPS + group), 0)
        _loss(rows, pairs_of(group, target % SIZE), np.repeat(np.take(weight, order), 2))
        for n, part in parts:
            np.matmul(sorted_[part].T, z[part], out=g_out[n])
            np.matmul(z[part], turned[n], out=within[part])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        back = np.take(within, place, 0)
        np.divide(back[:, d:].reshape(dh.shape), sums, out=dh)
        np.matmul(dh, x.transpose(0, 2, 1), out=ds)
        ds -= np.einsum("bsd,bsd->bs", dh, h)[:, :, None]
        ds *= s
        dx, dq = both.transpose(0, 2, 1) @ met, (ds @ x).reshape(-1, d)
        dx[:, WINDOW - step :] += (back[:, :d] + dq @ w["m"].T).reshape(q.shape)
        key = ids.ravel().astype(np.uint16)
        by = np.argsort(key, kind="stable")  # a radix sort
        key = np.take(key, by)
        edge = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        of_groups = g_out[:, :, :GROUPS].sum(0)
        g = {"P": dx.sum(0), "m": state[:, :d].T @ dq, "g": of_groups[:-1], "b": of_groups[-1], "y": g_out[:, :-1, GROUPS:], "c": g_out[:, -1, GROUPS:]}
        return g | {"rows": key[edge].astype(np.int64), "E": np.add.reduceat(np.take(dx.reshape(-1, d), by, 0), edge)}

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()]).astype(np.float32)

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for n, a in self.w.items():
            self.w[n], at = flat[at : at + a.size].reshape(a.shape).astype(np.float32), at + a.size


def _least(counts: DataFrame, most: int, cells: int = 4096) -> int:
    """The least t such that no more than ``most`` rows have a count (column n) of t or more; exact, by histograms of
    at most ``cells`` rows that narrow down to one count."""
    total, top = counts.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total <= most:
        return 1
    low, high, above = 1, top + 1, 0  # t lies in (low, high], rows from high on are ``above``
    while high - low > 1:
        width = -(-(high - low) // cells)
        part = counts.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(F.floor((F.col("n") - low) / width).cast("long").alias("c")).agg(F.count(F.lit(1)).alias("k"))
        for c, k in sorted(map(tuple, part.collect()), reverse=True):
            if above + k > most:
                low, high = low + c * width, min(high, low + (c + 1) * width)
                break
            above += k
        else:
            return low
    return high


def _count_pairs(path: str):
    """Counts of (id, next id) within the words of a vocabulary; -1 stands before a word and -2 after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if END in words:  # not a word of the tokenizer
                at = words.index(END)
                yield pa.RecordBatch.from_arrays([pa.array([-1, END_ID], pa.int64()), pa.array([END_ID, -2], pa.int64()), pa.array([n[at]] * 2, pa.int64())], names=["i", "j", "n"])
                words.pop(at)
                n = np.delete(n, at)
            if not words:
                continue
            ids, begin = sub.encode(words)
            sizes = np.diff(np.append(begin, len(ids)))
            left = np.concatenate([[-1], ids[:-1].astype(np.int64)])
            left[begin] = -1
            left = np.concatenate([left, ids[begin + sizes - 1]])
            right = np.concatenate([ids.astype(np.int64), np.full(len(words), -2)])
            code, place = np.unique((left << 20) + right, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((code + 2) >> 20), pa.array((code + 2 & 0xFFFFF) - 2), pa.array(np.bincount(place, np.concatenate([np.repeat(n, sizes), n]), len(code)).astype(np.int64))], names=["i", "j", "n"])

    return run


class Vocabulary:
    """The words of some texts with their ids, each encoded once, and their counts."""

    def __init__(self, sub: Subwords):
        self.sub, self.numbers = sub, defaultdict(count().__next__)
        self.ids, self.begin, self.counts, self.texts = np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def sequences(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, closed by END_ID."""
        texts, old = pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts, "")), WHITE), len(self.numbers)
        split = pc.ascii_split_whitespace(texts)
        words, some = split.flatten().cast(pa.binary()), pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64) * some
        words = (words if some.all() else words.filter(pc.greater(pc.binary_length(words), 0))).dictionary_encode()
        own = words.dictionary.to_numpy(zero_copy_only=False)
        at = np.take(np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own)), words.indices.to_numpy())
        ids, begin = self.sub.encode(list(islice(self.numbers, old, None)))
        self.begin = np.concatenate([self.begin[:-1], begin[: len(self.numbers) - old] + len(self.ids), [len(self.ids) + len(ids)]])
        self.ids = np.append(self.ids, ids)
        more = np.bincount(at, minlength=len(self.numbers))
        more[:old] += self.counts
        self.counts, self.texts = more, self.texts + len(texts)
        first = np.take(self.begin, at)
        long = np.take(self.begin, at + 1) - first
        ends = np.append(0, np.cumsum(long))
        flat = np.take(self.ids, np.repeat(first - ends[:-1], long) + np.arange(ends[-1]))
        edge = ends[np.append(0, np.cumsum(sizes))]
        return [np.append(flat[a:b], np.uint16(END_ID)) for a, b in zip(edge, edge[1:])]


def _pieces(path: str, counted: bool = False, most: int = 400_000):
    """Pieces of texts: the ids of up to PIECE targets, after the OVERLAP + 1 ids before them, with their number in the text.
    Counted: also rows of a word in place of ids and its count, with the turn -1; a word has several, one for each ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, known = np.full(OVERLAP + 1, END_ID, "<u2"), Vocabulary(subwords(path))
        batch_of = lambda *parts: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["key", "turn", "ids", "n"])
        words = lambda: batch_of(np.zeros(len(known.numbers) + 1, np.int64), np.full(len(known.numbers) + 1, -1), [*known.numbers, END], np.append(known.counts, known.texts))
        for batch in batches:
            rows, sizes, keys, turns = [], [], [], []
            for key, ids in zip(batch.column(0).to_pylist(), known.sequences(batch.column(1))):
                ids = np.append(before, ids).astype("<u2", copy=False).tobytes()
                for i in range(0, len(ids) // 2 - OVERLAP - 1, PIECE):
                    rows.append(ids[2 * i : 2 * (i + OVERLAP + 1 + PIECE)])
                    sizes.append(len(rows[-1]) // 2 - OVERLAP - 1)
                    keys.append(key)
                    turns.append(i)
            yield batch_of(keys, turns, rows, sizes)
            if len(known.numbers) > most:
                if counted:
                    yield words()
                known = Vocabulary(subwords(path))
        if counted and known.texts:
            yield words()

    return run


def _deal(train: DataFrame, path: str, folder: str, counted: bool = False) -> DataFrame:
    """Writes the pieces of all texts (rows of an id and a text), by their rounds; what is counted has the round -1."""
    keyed = train.select(F.xxhash64(F.lit("lm-deal"), F.col(train.columns[0])), train.columns[1])
    table = keyed.mapInArrow(_pieces(path, counted), "key long, turn long, ids binary, n long").select(F.when(F.col("turn") < 0, 0).otherwise(F.xxhash64("key", "turn", "ids")).alias("hash"), "ids", "n", "turn")
    table = table.withColumn("round", F.when(F.col("turn") < 0, -1).otherwise(F.pmod("hash", F.lit(len(ROUNDS)))).cast("int")).drop("turn")
    table.write.partitionBy("round").parquet(f"{folder}/pieces")
    return train.sparkSession.read.schema(table.schema).parquet(f"{folder}/pieces")


def piece_windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets of the places from OVERLAP on, and which of these are ids of the text: every target of the pieces once."""
    step, before = WINDOW - OVERLAP, OVERLAP + 1
    parts = [np.frombuffer(x, "<u2") for x in pieces]
    sizes = np.array([len(x) - before for x in parts])
    n = -(-sizes // step)
    whose = np.repeat(np.arange(len(parts)), n)
    turn = (np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)) * step
    flat = np.concatenate([*parts, np.full(WINDOW + 1, END_ID, "<u2")])
    starts = np.cumsum(sizes + before) - sizes - before
    at = (starts[whose] + turn)[:, None] + np.arange(WINDOW)
    return flat[at], flat[at[:, OVERLAP:] + 1], turn[:, None] + np.arange(step) < sizes[whose][:, None]


def fit_all(train: DataFrame, model: Model, path: str, folder: str, table: DataFrame | None = None) -> int:
    """Fits the weights on every window of all texts (rows of an id and a text; table: their pieces, if written); the number
    of targets."""
    spark = train.sparkSession
    table = (_deal(train, path, folder) if table is None else table).where("round >= 0")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, round(total / len(ROUNDS) / SHARD))
    begun = spark.sparkContext.broadcast(model)
    seen = 0
    for turn, rate in enumerate(ROUNDS):
        weights = spark.sparkContext.broadcast(model.flat())

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("hash", "ascending"), ("ids", "ascending")])
            lm, n = begun.value, sum(group.column("n").to_pylist())
            lm.take(weights.value)
            lm.fit(*piece_windows(group.column("ids").to_pylist()), epochs=1, rate=rate, batch=BATCH)
            return pa.table({"n": pa.array([n], pa.int64()), "w": pa.array([(lm.flat() * np.float32(n / SHARD)).tobytes()], pa.binary())})

        mine = table.where(F.col("round") == turn).select(F.pmod(F.shiftright("hash", 8), F.lit(shards)).alias("shard"), "hash", "ids", "n")
        done = mine.groupBy("shard").applyInArrow(run, "n long, w binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.float32)))
        n, w = done.treeAggregate((0, np.float32(0)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
        if n:
            model.take(w / np.float32(n / SHARD))
        seen += n
        weights.destroy()
    begun.destroy()
    if seen != total:
        raise RuntimeError(f"fitted on {seen} of {total} targets")
    return seen


def columns(table: DataFrame, names: str) -> np.ndarray:
    """A bounded table of integers, the last of them counts, as rows of int64."""
    got = table.select(*[F.col(c).cast("int") for c in names[:-1]], names[-1]).toArrow()
    return np.stack([got.column(c).to_numpy() for c in names], 1, dtype=np.int64)


NEW = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, head: int = HEAD, most_pairs: int = PAIRS) -> DataFrame:
    """A row for each of docs: its other columns and n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    path, folder = ranks or default_ranks(), scratch(spark, "lm")
    train = docs.where(learn).select(id_col, text_col)
    pieces = _deal(train, path, folder, counted=True)
    counted = pieces.where("round = -1").groupBy(F.col("ids").alias("word")).agg(F.sum("n").alias("n"))
    vocabulary = save(counted, f"{folder}/words")
    short, is_end = F.octet_length("word") < 64, F.col("word") == F.lit(END)
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(is_end, F.col("n"))), F.lit(0))).first()
    n_all, v_all, n_ends = map(int, totals)
    least = _least(vocabulary, head)
    frequent = vocabulary.where((F.col("n") >= least) & short & ~is_end).toArrow().combine_chunks()
    rest = vocabulary.where(((F.col("n") < least) | ~short) & ~is_end)
    pairs = save(vocabulary.mapInArrow(_count_pairs(path), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")), f"{folder}/pairs")
    counts = np.zeros(IDS)
    for r in pairs.where("j >= 0").groupBy("j").agg(F.sum("n").alias("n")).collect():
        counts[r["j"]] = r["n"]
    model = Model(counts, subwords(path).starts)
    # pairs of ids become pairs of an id and a class; both tables are bounded by the vocabulary of the tokenizer
    classes = spark.createDataFrame([(-2, -1, 0.0), *zip(range(IDS), model.of.tolist(), np.exp(model.inside).tolist())], "j long, c long, share double")
    found = columns(pairs.join(F.broadcast(classes), "j").groupBy("i", "c").agg(F.sum("n").alias("n")), "icn")
    starts = np.zeros(CLASSES)
    begin = found[found[:, 0] < 0]
    starts[begin[:, 1]] = begin[:, 2]
    found = found[found[:, 0] >= 0]
    model.follow(found, starts)
    inner = pairs.where("i >= 0 and j >= 0")
    from_n = _least(inner, most_pairs)
    model.within(columns(inner.where(F.col("n") >= from_n), "ijn"), found[found[:, 1] >= 0], from_n > 1)
    del found
    fit_all(train, model, path, folder, pieces)
    shared = spark.sparkContext.broadcast((frequent, model.freeze()))
    end_log = float(np.log10(n_ends + 1))
    others = [f for f in docs.schema if f.name != text_col and f.name.lower() not in NEW]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lm = shared.value
        sub, part, row = subwords(path), TaskContext.get().partitionId(), 0
        if lm.numbers is None:
            lm.know(sub, table.column("word").to_pylist(), table.column("n").to_numpy(), n_ends, n_all)
        for batch in batches:
            tokens, texts, held, done = [], [], 0, []
            first = (part << 36) + row
            for text in batch.column(text_col).to_pylist():
                texts.append(words_of(text))
                tokens.append(len(texts[-1]) + 1)
                held += tokens[-1]
                if held > 1 << 16:
                    done.append((len(tokens) - len(texts), *lm.block(sub, texts)))
                    texts, held = [], 0
            if texts:
                done.append((len(tokens) - len(texts), *lm.block(sub, texts)))
            row += len(tokens)
            uid = np.arange(first, first + len(tokens))
            known, sums, scores = (np.concatenate([b[k] for b in done] or [np.zeros(0)]) for k in (1, 2, 3))
            known, sums = known.astype(np.int64) + (n_ends > 0), sums + (end_log if n_ends else 0.0)
            flat = lambda k: np.concatenate([b[k] for b in done] or [np.zeros(0)])
            rows_of = lambda k: np.concatenate([first + b[0] + b[k] for b in done] or [np.zeros(0)])
            words = [w for b in done for w in b[6]]
            n, m, k = len(uid), len(words), sum(len(b[9]) for b in done)
            mine = [pa.concat_arrays([batch.column(x), pa.nulls(m + k, batch.column(x).type)]) for x in names]
            three = lambda t, a, b, c: pa.concat_arrays([pa.nulls(z, t) if x is None else pa.array(x, t) for x, z in ((a, n), (b, m), (c, k))])
            whole = lambda *parts: [x.astype(np.int64) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    *mine,
                    three(pa.int64(), *whole(uid, rows_of(4), rows_of(9))),
                    three(pa.int64(), *whole(np.array(tokens), flat(5), flat(10))),
                    three(pa.int64(), known, None, None),
                    three(pa.float64(), sums, flat(7), None),
                    three(pa.float64(), scores, flat(8), None),
                    three(pa.binary(), None, words, None),
                    three(pa.int64(), None, None, *whole(flat(11))),
                ],
                names=[*names, *ROW],
            )

    from pyspark.sql import types as T

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BinaryType(), T.LongType()]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in others], *[T.StructField(n, t) for n, t in zip(ROW, kinds)]])
    rows = save(docs.mapInArrow(run, schema), f"{folder}/rows")
    # words that were not shared, and words with a pair that was not: what their counts add to the score
    occ = rows.where(F.col("__lm_word").isNotNull()).select("__lm_row", F.col("__lm_n").alias("place"), F.col("__lm_word").alias("word"), F.col("__lm_sum").alias("share"), F.col("__lm_score").alias("say"))
    rare = occ.join(rest, "word", "inner" if from_n == 1 else "left")
    gain = F.lit(0.0)
    if from_n > 1:
        more = F.log10((F.col("n") + PSEUDO * F.col("share")) / (PSEUDO * F.col("share")))
        left = inner.where(F.col("n") < from_n).join(F.broadcast(classes), "j").select(F.shiftleft("i", 16).bitwiseOR(F.col("j")).alias("pair"), more.alias("gain"))
        gains = rows.where(F.col("__lm_pair").isNotNull()).select("__lm_row", F.col("__lm_n").alias("place"), F.col("__lm_pair").alias("pair")).join(left, "pair")
        rare = rare.join(gains.groupBy("__lm_row", "place").agg(F.sum("gain").alias("gain")), ["__lm_row", "place"], "left")
        gain = F.coalesce("gain", F.lit(0.0))
    n, said = F.coalesce("n", F.lit(0)), lambda g: F.lit(1 - UNIGRAM) * F.pow(F.lit(10.0), F.col("say") + g)
    grown = F.log10(F.col("share") + F.lit(UNIGRAM / max(1, n_all)) * n + said(gain)) - F.log10(F.col("share") + said(F.lit(0.0)))
    rare = rare.groupBy("__lm_row").agg(F.count("n").alias("__lm_m"), F.sum(F.log10(n + 1)).alias("__lm_more"), F.sum(grown).alias("__lm_grown"))
    out = rows.where(F.col("__lm_word").isNull() & F.col("__lm_pair").isNull()).join(rare, "__lm_row", "left")
    total = F.col("__lm_score") + F.coalesce("__lm_grown", F.lit(0.0))
    floor = F.log10(F.lit(float(n_all + v_all + 1)))
    return out.select(
        *names,
        F.col("__lm_n").alias("n_tokens"),
        (F.col("__lm_known") + F.coalesce("__lm_m", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("__lm_sum") + F.coalesce("__lm_more", F.lit(0.0)) - F.col("__lm_n") * floor).alias("base_score"),
        total.alias("score"),
    )


ROW = ["__lm_row", "__lm_n", "__lm_known", "__lm_sum", "__lm_score", "__lm_word", "__lm_pair"]


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    crc = crc_of_id(F.col("doc_id")) % 7
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(crc == 2, F.lit(False)).alias("held_out"), "text")
    return score(docs, F.coalesce(crc != 2, F.lit(False)))
