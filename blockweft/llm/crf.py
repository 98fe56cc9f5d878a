"""Linear-chain conditional random field over words: features, training and forward-backward, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .textnum import batches, mixed, span_hashes, word_bounds

#: Rows of the tables of hashed character n-grams and affixes, and the most words of the learned lexicon.
NGRAMS, AFFIXES, LEXICON = 1 << 15, 1 << 14, 50_000
#: Bytes of text that are tagged at once, which bounds a task's memory.
TAG_BATCH = 500_000
#: Words of a chunk in forward-backward.
CHUNK = 128
#: Neighbours whose expected labels are summed at once in training, which bounds its memory.
PAIRS = 1 << 15

#: Bytes of words: Latin letters, and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[65:91] = True
LETTERS[128:] = True


def lowered(text: str) -> str:
    """Lower case, code point by code point where the whole would change its length: offsets are those of the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Bytes of the lower-cased texts, starts and ends of their words, hashes of the words, first word and first byte of
    each text and of one more."""
    raw = [lowered(t).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts, ends = word_bounds(data, LETTERS)
    lengths = np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, begin), begin


@dataclass
class Features:
    """Feature rows of different words: n-grams as one run of ids a word, affixes as columns, the lexicon id (-1: none)."""

    ngrams: np.ndarray
    first: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> Features:
    """Features of the words at ``starts``: byte trigrams with both edges, prefixes and suffixes of 2 to 4 bytes."""
    lengths = ends - starts
    # each word with a byte before it and one after it, which are no letters and mark its edges
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    at = np.repeat(starts - first, lengths) + np.arange(lengths.sum())
    edge = np.concatenate((data.astype(np.uint64), np.zeros(1, np.uint64)))
    mid, before, after = edge[at], np.where(np.isin(at, starts), 0, edge[at - 1]), np.where(np.isin(at + 1, ends), 0, edge[np.minimum(at + 1, len(edge) - 1)])
    with np.errstate(over="ignore"):
        ngrams = (mixed((before << np.uint64(16)) | (mid << np.uint64(8)) | after) % np.uint64(NGRAMS)).astype(np.int64)
    columns = []
    for n in (2, 3, 4):
        cut = np.minimum(lengths, n)
        columns.append(mixed(span_hashes(data, starts, starts + cut) + np.uint64(n)) % np.uint64(AFFIXES))
        columns.append(mixed(span_hashes(data, ends - cut, ends) + np.uint64(16 + n)) % np.uint64(AFFIXES))
    known = np.full(len(hashes), -1, np.int64)
    if len(lexicon) and len(hashes):
        place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = np.where(lexicon[place] == hashes, place, -1)
    return Features(ngrams, first, np.stack(columns, 1).astype(np.int64) if len(hashes) else np.zeros((0, 6), np.int64), known)


@dataclass
class Model:
    labels: list[str]
    lexicon: np.ndarray
    w_ngram: np.ndarray
    w_affix: np.ndarray
    w_word: np.ndarray
    bias: np.ndarray
    transition: np.ndarray

    def small(self) -> Model:
        """The same with weights of half the bytes, as it travels to tasks."""
        return Model(self.labels, self.lexicon, *(w.astype(np.float32) for w in (self.w_ngram, self.w_affix, self.w_word)), self.bias, self.transition)

    def emissions(self, f: Features) -> np.ndarray:
        out = np.tile(self.bias, (len(f.lexicon), 1))
        if len(out):
            # the mean, so that long words don't outweigh all else
            sizes = np.diff(np.append(f.first, len(f.ngrams)))[:, None]
            out += np.add.reduceat(self.w_ngram[f.ngrams], f.first) / np.sqrt(sizes)
            out += self.w_affix[f.affixes].sum(1)
            known = f.lexicon >= 0
            out[known] += self.w_word[f.lexicon[known]]
        return out


def forward_backward(emit: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Label marginals of each word, exactly, for sequences emit[first[k]:first[k+1]]."""
    return marginals(emit, first, transition)[0]


def marginals(emit: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label marginals of each word; with ``pairs`` also the sum over all neighbours of the marginals of label pairs.

    Sequences are cut into chunks that all run at once: each chunk's transfer matrix, then the vectors at chunk ends
    along each sequence, then the words within chunks. So a text of any length takes as many steps as a short one.
    """
    n_labels = emit.shape[1]
    total = len(emit)
    if not total:
        return np.zeros((0, n_labels)), np.zeros((n_labels, n_labels)) if pairs else None
    lengths = np.diff(first)
    pieces = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    first_piece = np.concatenate(([0], np.cumsum(pieces)))
    rank = np.arange(len(owner)) - first_piece[owner]
    begin = first[owner] + rank * CHUNK
    size = np.minimum(first[owner + 1] - begin, CHUNK)
    step = np.exp(transition - transition.max())
    psi = np.exp(emit - emit.max(1, keepdims=True))

    def at(t: int) -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(size > t)
        return live, psi[begin[live] + t]

    # the step into a sequence's first word has no transition
    into = np.where((rank == 0)[:, None, None], np.eye(n_labels), step)
    carry = np.tile(np.eye(n_labels), (len(owner), 1, 1))
    for t in range(int(size.max())):
        live, p = at(t)
        moved = carry[live] @ (into[live] if t == 0 else step)
        moved *= p[:, None, :]
        carry[live] = moved / moved.sum((1, 2), keepdims=True)
    ahead = np.full((len(owner), n_labels), 1.0 / n_labels)
    behind = np.ones((len(owner), n_labels))
    for k in range(1, int(pieces.max())):
        now = np.flatnonzero(rank == k)
        v = np.einsum("il,ilm->im", ahead[now - 1], carry[now - 1])
        ahead[now] = v / v.sum(1, keepdims=True)
    for k in range(int(pieces.max()) - 1, 0, -1):
        now = np.flatnonzero(rank == k)
        v = np.einsum("ilm,im->il", carry[now], behind[now])
        behind[now - 1] = v / v.sum(1, keepdims=True)

    alpha = np.empty((total, n_labels))
    v = ahead.copy()
    for t in range(int(size.max())):
        live, p = at(t)
        moved = (np.einsum("il,ilm->im", v[live], into[live]) if t == 0 else v[live] @ step) * p
        moved /= moved.sum(1, keepdims=True)
        v[live] = alpha[begin[live] + t] = moved
    out = np.empty_like(alpha)
    # behind[k] already holds the step into the next chunk
    v = behind.copy()
    beta = np.empty_like(alpha) if pairs else None
    for t in range(int(size.max()) - 1, -1, -1):
        live, p = at(t)
        if beta is not None:
            beta[begin[live] + t] = p * v[live]
        gamma = alpha[begin[live] + t] * v[live]
        out[begin[live] + t] = gamma / gamma.sum(1, keepdims=True)
        if t:
            moved = (p * v[live]) @ step.T
            v[live] = moved / moved.sum(1, keepdims=True)
    if beta is None:
        return out, None
    # a step from one word to the next: all before it, the transition, all from the next word on
    inner = np.ones(total, bool)
    inner[first[:-1][first[:-1] < total]] = False
    into_words, expected = np.flatnonzero(inner), np.zeros((n_labels, n_labels))
    for some in np.split(into_words, range(PAIRS, len(into_words), PAIRS)):
        pair = alpha[some - 1][:, :, None] * step * beta[some][:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return out, expected


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position and the end, the code points that begin before it."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


@dataclass
class Tagged:
    """Texts a to b of a list: bounds of their words in code points of each text, first word of each text, marginals."""

    a: int
    b: int
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    gamma: np.ndarray

    def spans(self, chosen: np.ndarray, labels: list[str] | None = None) -> list[str]:
        """For each text the runs of neighbouring words of one value of ``chosen`` that is not negative, as start:end,
        joined by commas; with ``labels`` the value's label and a colon before each."""
        opens = np.ones(len(chosen), bool)
        opens[1:] = chosen[1:] != chosen[:-1]
        opens[self.first[:-1][self.first[:-1] < len(chosen)]] = True
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(chosen)) - 1
        keep = chosen[at] >= 0
        at, last = at[keep], last[keep]
        shown = [f"{labels[v] + ':' if labels else ''}{s}:{e}" for v, s, e in zip(chosen[at].tolist(), self.starts[at].tolist(), self.ends[last].tolist(), strict=True)]
        cuts = np.searchsorted(at, self.first).tolist()
        return [",".join(shown[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def tag(model: Model, texts: list[str]) -> Iterator[Tagged]:
    """The texts in batches, with the label marginals of all words."""
    sizes = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in batches(sizes, TAG_BATCH):
        data, starts, ends, hashes, first, begin = words_of(texts[a:b])
        _, one, where = np.unique(hashes, return_index=True, return_inverse=True)
        emit = model.emissions(features(data, starts[one], ends[one], hashes[one], model.lexicon))
        points = code_points(data)
        zero = np.repeat(points[begin[:-1]], np.diff(first))
        yield Tagged(a, b, points[starts] - zero, points[ends] - zero, first, forward_backward(emit[where], first, model.transition))


def train(texts: list[str], word_labels: list[np.ndarray], labels: list[str], rounds: int = 30, rate: float = 0.3, decay: float = 1e-5, least: int = 3) -> Model:
    """Fit by gradient steps of the log-likelihood (a step size for each weight), over all sequences at once.

    ``word_labels`` has a label index for each word of each text. Words that occur ``least`` times form the lexicon.
    """
    data, starts, ends, hashes, first, _ = words_of(texts)
    gold = np.concatenate(word_labels).astype(np.int64) if word_labels else np.zeros(0, np.int64)
    kinds, one, where, seen = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    often = np.argsort(-seen, kind="stable")[:LEXICON]
    lexicon = np.sort(kinds[often[seen[often] >= least]])
    f = features(data, starts[one], ends[one], kinds, lexicon)
    n = len(labels)
    model = Model(labels, lexicon, np.zeros((NGRAMS, n)), np.zeros((AFFIXES, n)), np.zeros((len(lexicon), n)), np.zeros(n), np.zeros((n, n)))
    weights = [model.w_ngram, model.w_affix, model.w_word, model.bias, model.transition]
    squares = [np.full_like(w, 1e-6) for w in weights]
    inner = np.ones(len(gold), bool)
    inner[first[:-1][first[:-1] < len(gold)]] = False
    into = np.flatnonzero(inner)
    counts = np.zeros((n, n))
    np.add.at(counts, (gold[into - 1], gold[into]), 1)
    sizes = np.diff(np.append(f.first, len(f.ngrams)))
    known = np.flatnonzero(f.lexicon >= 0)
    target = np.zeros((len(gold), n))
    target[np.arange(len(gold)), gold] = 1
    for _ in range(rounds if len(gold) else 0):
        emit = model.emissions(f)[where]
        gamma, expected = marginals(emit, first, model.transition, pairs=True)
        off = target - gamma
        by_kind = np.stack([np.bincount(where, off[:, k], len(kinds)) for k in range(n)], 1)
        spread = np.repeat(by_kind / np.sqrt(sizes)[:, None], sizes, 0)
        grads = [
            np.stack([np.bincount(f.ngrams, spread[:, k], NGRAMS) for k in range(n)], 1),
            np.stack([np.bincount(f.affixes.ravel(), np.repeat(by_kind[:, k], f.affixes.shape[1]), AFFIXES) for k in range(n)], 1),
            np.zeros_like(model.w_word),
            off.sum(0),
            counts - expected,
        ]
        grads[2][f.lexicon[known]] = by_kind[known]
        for w, g, s in zip(weights, grads, squares, strict=True):
            g = g - decay * len(gold) * w * 1e-2
            s += g * g
            w += rate * g / np.sqrt(s)
    return model
