"""Toxicity of restored text: a noisy channel undoes obfuscation, a linear model scores the words.

Written text is a lattice: each character may stand for itself or for letters it imitates, separators
inside a word and punctuation at its edges may be nothing, a space may be nothing, and a run of a letter
may be fewer of them. Viterbi decoding finds the likeliest text under the channel and a character trigram
model, which is counted over every document.

The restored words' presence is scored by logistic regression, trained on a bounded sample of labelled
rows (TRAIN_ROWS, those with the lowest hashes) outside the held-out fold; its features are the words most
associated with the label there, and the stems that at least two different words of a text start with, since insults are
inflected and each form is rare. In training and in scoring alike, only those lattices are decoded that have a path
to a feature: a skeleton (look-alikes as one letter, runs as one, separators out) is the same for all paths of a
lattice, so a look-up of skeletons finds them. Over word bounds the look-up walks on from each word that starts a feature's
skeleton, for all such words of a batch at once: a step is made once for each distinct pair of what was walked and the next word.

Defined results: null and empty texts have no words and score the model's prior. Repeated rows score alike.
Without labelled rows of both kinds every score is the share of toxic labels, or 0. An empty table gives no
rows. Texts of any length are scored whole. Of the other columns only the id is read, so none can clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, mix, powers, sampled, stage, text_chunks

TRAIN_ROWS, FEATURES, MIN_DOCS = 20_000, 400, 5
#: Stems among the features, their lengths, and how many different words of a text must start with one.
STEMS, STEM_LENGTHS, STEM_WORDS = 100, range(4, 9), 2
CACHE_WORDS = 300_000
#: Written runs up to this long are remembered with what they decode to.
CACHE_RUN = 200

#: What a character may imitate.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'`^,:;#"
#: Log probabilities of the channel: of a look-alike, of a separator, of punctuation at an edge, of a repeated letter, of a space that is none.
IMITATED, DROPPED, EDGE, REPEATED, JOINED, ODD = -0.7, -0.2, -0.1, -0.3, -1.0, -8.0
#: Between single characters, words are spelt out: a space is most likely none, and one that is a space is rare.
SPELT_JOINED, SPELT_BOUND = -0.1, -1.5
#: Single characters in a row that may be a word spelt out.
SPELT = 3
#: Bytes of text, about, that are scored at once.
TEXT_BYTES = 2 << 20

_EDGES = re.compile(r"^[^\w]*|[^\w]*$")
_PLAIN = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"(.)\1\1")
_LETTERED = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1+")

# --- character model: a-z, one class for other letters, one for the edge of a word ------------------
_CLASSES = 28
_CLASS = np.full(256, 27, np.int64)
_CLASS[:128] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)


def _count_trigrams(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total = np.zeros(_CLASSES**3, np.int64)
    for batch in batches:
        for _, _, texts in text_chunks(batch.column(0)):
            data = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)
            c = _CLASS[data[(data & 0xC0) != 0x80]]  # a character is one, of however many bytes
            total += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(next | two before), add-one smoothed, from all documents; a fixed number of figures."""
    rows = docs.select(text_col).mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.ones(_CLASSES**3)
    for r in rows:
        counts[r.gram] += r.n
    cube = counts.reshape(_CLASSES, _CLASSES, _CLASSES)
    return np.log(cube / cube.sum(axis=2, keepdims=True))


class Decoder:
    """Viterbi decoding of written text, word by word or over spaces that may be none."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    @staticmethod
    def _class(ch: str) -> int:
        return ord(ch) - 96 if "a" <= ch <= "z" else (27 if ch > "\x7f" else 0)

    @staticmethod
    def lattice(written: str) -> list[list[tuple[str, float]]]:
        """What each character may stand for ("" is nothing), with the channel's log probability."""
        out, before = [], 0
        for word in written.lower().split(" "):
            bare = _EDGES.sub("", word)
            if out:
                out.append([(" ", SPELT_BOUND), ("", SPELT_JOINED)] if before <= 1 and len(bare) <= 1 else [(" ", 0.0), ("", JOINED)])
            before = len(bare)
            first = word.find(bare) if bare else len(word)
            for i, ch in enumerate(word):
                options = [(ch, 0.0)] if ch.isalpha() else []
                options += [(x, IMITATED) for x in LOOKALIKES.get(ch, "")]
                if not first <= i < first + len(bare):
                    options.append(("", EDGE))
                elif ch in SEPARATORS:
                    options.append(("", DROPPED))
                out.append(options or [(ch, ODD)])
        return out

    def decode(self, written: str) -> str:
        """The likeliest plain text. State: the last two letters; of equal scores the later text in order."""
        model, cls = self.model, self._class
        states: dict[tuple[str, str], tuple[float, str]] = {("", ""): (0.0, "")}
        for options in self.lattice(written):
            nxt: dict[tuple[str, str], tuple[float, str]] = {}
            for (p, q), (score, path) in states.items():
                for x, cost in options:
                    if not x:
                        self._keep(nxt, (p, q), score + cost, path)
                        continue
                    self._keep(nxt, (q, x), score + cost + model[cls(p) if p else 0][cls(q) if q else 0][cls(x)], path + x)
                    if x == q:
                        self._keep(nxt, (p, q), score + cost + REPEATED, path)
            states = nxt
        return max((s + model[cls(p) if p else 0][cls(q) if q else 0][0], path) for (p, q), (s, path) in states.items())[1]

    @staticmethod
    def _keep(states: dict, key: tuple[str, str], score: float, path: str) -> None:
        known = states.get(key)
        if known is None or (score, path) > known:
            states[key] = (score, path)


def looks_obfuscated(word: str) -> bool:
    """Letters mixed with what imitates or separates letters, or a letter three times running."""
    return not _PLAIN.fullmatch(word) and bool(_LETTERED.search(word)) or bool(_TRIPLE.search(word))


class Restorer(dict):
    """Written word to restored word, remembered; of the labelled sample, every word that looks obfuscated."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.decoder = Decoder(model)

    def __missing__(self, word: str) -> str:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bare = _EDGES.sub("", word).lower()
        found = self[word] = self.decoder.decode(word) if looks_obfuscated(bare) else bare
        return found

    def words(self, text: str) -> list[str]:
        """The restored words; single characters in a row are decoded together as well."""
        written = text.split()
        out = [self[w] for w in written]
        single = np.fromiter(map(len, written), np.int64, len(written)) == 1
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= SPELT:
                    out += self.decoder.decode(" ".join(written[a:b])).split(" ")
        return out


#: One letter for all that may be mistaken for each other.
_SAME = str.maketrans({ch: ("i" if "l" in x or "i" in x else x[0]) for ch, x in LOOKALIKES.items()} | {"l": "i"} | dict.fromkeys(SEPARATORS))


def skeleton(letters: str) -> str:
    """The same for all readings of some characters: look-alikes as one letter, runs as one, no separators."""
    return _RUN.sub(r"\1", letters.translate(_SAME))


#: Code points below this are told in numpy; words with others are always looked at one by one.
_NEAR = 0x3000
_IN_WORD = np.array([chr(c).isalnum() or c == 95 for c in range(_NEAR)])
_SKELETON = np.arange(_NEAR, dtype=np.uint32)
for _code, _char in _SAME.items():
    if _code < _NEAR:
        _SKELETON[_code] = ord(_char) if _char else 0
#: Characters that may stand for a letter at a word's edge, or be nothing there.
_EITHER = np.zeros(_NEAR, bool)
_EITHER[[ord(ch) for ch in LOOKALIKES if not ch.isalnum() and ord(ch) < _NEAR]] = True


def skeleton_hashes(words: list[str], lengths: list[int] | tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """A hash of each word's skeleton without the punctuation at its edges; which words must be looked at one by one: those that
    have several skeletons, an empty one or far characters; and, for each length, hashes of the first characters of skeletons that long."""
    if not words:
        none = np.zeros(0, np.uint64)
        return none, none.astype(bool), dict.fromkeys(lengths, none)
    codes = np.frombuffer("\n".join([*words, ""]).lower().encode("utf-32-le"), np.uint32)
    end = np.flatnonzero(codes == 10)
    start = np.append(0, end[:-1] + 1)
    far = codes >= _NEAR
    near = np.where(far, 0, codes)
    inside = _IN_WORD[near]
    place = np.arange(len(codes))
    owner = np.searchsorted(end, place)
    first = np.minimum.reduceat(np.where(inside, place, len(codes)), start)
    last = np.maximum.reduceat(np.where(inside, place, -1), start)
    odd = np.logical_or.reduceat(far | _EITHER[near], start) | (last < 0) | (end == start)
    mapped = _SKELETON[near]
    kept = np.flatnonzero((place >= first[owner]) & (place <= last[owner]) & (mapped != 0))
    if len(kept):
        again = np.zeros(len(kept), bool)
        again[1:] = (mapped[kept[1:]] == mapped[kept[:-1]]) & (owner[kept[1:]] == owner[kept[:-1]])
        kept = kept[~again]
    hashes, heads = np.zeros(len(words), np.uint64), {k: np.zeros(len(words), np.uint64) for k in lengths}
    if len(kept):
        own = owner[kept]
        head = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(np.append(head, len(own)))
        offset = np.arange(len(own)) - np.repeat(head, size)
        terms = mix(mapped[kept].astype(np.uint64)) * powers(int(size.max()))[offset]
        hashes[own[head]] = np.add.reduceat(terms, head)
        running = np.cumsum(terms)  # sums wrap, and their differences are right
        before = running[head] - terms[head]
        for k in lengths:
            long = size >= k
            heads[k][own[head[long]]] = running[head[long] + k - 1] - before[long]
    return hashes, odd, heads


class Scorer:
    """Finds the features in texts, given as Arrow arrays.

    Only words whose skeleton is part of a feature's can be one, start one or go on with one, so all others are passed
    over by a look-up of hashes, a batch at a time.
    """

    def __init__(self, model: np.ndarray, features: dict[str, int], known: set[str], stems: dict[str, int] | None = None):
        """features and stems: to numbers that go on from one to the other."""
        self.decoder, self.features, self.known, self.stems = Decoder(model), features, known, stems or {}
        self.n = max(1, len(self.features) + len(self.stems))
        #: How often a letter stands in a run is a guess of the decoder: what differs in that alone is one feature, the one with more gain.
        self.collapsed: dict[str, int] = {}
        for word, i in features.items():
            self.collapsed.setdefault(_RUN.sub(r"\1", word), i)
        self.heads = {len(x): np.unique(skeleton_hashes([y for y in map(skeleton, self.stems) if len(y) == len(x)])[0]) for x in map(skeleton, self.stems)}
        self.whole = {skeleton(w) for w in features}
        self.starts = {x[:n] for x in self.whole for n in range(1, len(x) + 1)}
        parts = {x[i:j] for x in self.whole for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        self.parts = np.unique(skeleton_hashes(sorted(parts))[0])
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, tuple[int, frozenset[str], int, bool]] = {}
        self.decoded: dict[str, int] = {}
        #: What was walked (the skeletons that may go on, and whether one is a feature's), by number; steps from one to the next.
        self.walked: list[tuple[frozenset[str], bool]] = []
        self.number: dict[frozenset[str], int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        #: Restored words, by number, and the stems that each starts with.
        self.restored: dict[str, tuple[str, list[int]]] = {}

    def _feature(self, written: str) -> int:
        """The feature that the lattice decodes to, or -1."""
        found = self.decoded.get(written)
        if found is None:
            plain = self.decoder.decode(written).strip()
            found = self.features.get(plain, self.collapsed.get(_RUN.sub(r"\1", plain), -1))
            if len(written) <= CACHE_RUN:
                self.decoded[written] = found
        return found

    def _numbered(self, bodies: frozenset[str]) -> int:
        """The number of what was walked, -1 if no feature starts so."""
        if not bodies:
            return -1
        found = self.number.get(bodies)
        if found is None:
            found = self.number[bodies] = len(self.walked)
            self.walked.append((bodies, not bodies.isdisjoint(self.whole)))
        return found

    def _word(self, word: str) -> tuple[int, frozenset[str], int, bool]:
        """The feature that a word is, its skeletons (with and without the punctuation at its edges), where a walk from it starts,
        and whether repeating it adds nothing."""
        found = self.seen.get(word)
        if found is None:
            low = word.lower()
            if low.isalpha():
                bare, bodies = low, frozenset((skeleton(low),))
            else:
                bare = _EDGES.sub("", low)
                at = low.find(bare) if bare else len(low)
                edges = [{"".join(ch for ch in e if ch in LOOKALIKES), ""} for e in (low[:at], low[at + len(bare) :])]
                bodies = frozenset(skeleton(x + bare + y) for x in edges[0] for y in edges[1])
            feature = self.features.get(bare, -1)
            if feature < 0 and not bodies.isdisjoint(self.whole) and bare not in self.known:
                feature = self._feature(word)
            found = self.seen[word] = (feature, bodies, self._numbered(bodies & self.starts), all(len(x) <= 1 for x in bodies))
        return found

    def _step(self, walked: int, word: str) -> int:
        found = self.steps.get((walked, word))
        if found is None:
            bodies = self._word(word)[1]
            found = self.steps[walked, word] = self._numbered(frozenset({skeleton(x + y) for x in self.walked[walked][0] for y in bodies} & self.starts))
        return found

    def _partial(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words that may be part of a feature, and those that may start with a stem."""
        hashes, odd, heads = skeleton_hashes(words, sorted(self.heads))
        stemmed = odd.copy() if self.stems else np.zeros(len(words), bool)
        for length, own in heads.items():
            stemmed |= np.isin(own, self.heads[length])
        return np.flatnonzero(odd | np.isin(hashes, self.parts)), np.flatnonzero(stemmed)

    def _stems(self, word: str) -> tuple[str, list[int]]:
        """The restored word and the stems that it starts with."""
        found = self.restored.get(word)
        if found is None:
            bare = _EDGES.sub("", word).lower()
            if looks_obfuscated(bare):
                bare = self.decoder.decode(word).strip()
            found = self.restored[word] = (bare, [self.stems[bare[:k]] for k in STEM_LENGTHS if bare[:k] in self.stems and len(bare) >= k])
        return found

    def _stemmed(self, words: list[str], near: np.ndarray, code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and stems that enough different words of a text start with."""
        place: dict[str, int] = {}
        pairs = [(int(i), place.setdefault(bare, len(place)), stem) for i in near for bare, stems in (self._stems(words[i]),) for stem in stems]
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, bare, stem = np.array(pairs, np.int64).T  # in order of words
        first = np.searchsorted(word, np.arange(len(words) + 1))
        hit = np.flatnonzero(first[code + 1] > first[code])
        count = (first[1:] - first[:-1])[code[hit]]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[code[hit]], count)
        told = np.unique(np.stack([np.repeat(owner[hit], count), stem[at], bare[at]], axis=1), axis=0)
        both, n = np.unique(told[:, :2], axis=0, return_counts=True)
        return both[n >= STEM_WORDS].T

    def _joined(self, words: list[str], code: np.ndarray, owner: np.ndarray, start: np.ndarray, single: np.ndarray, partial: np.ndarray) -> tuple[list[int], list[int]]:
        """Texts and features of the lattices over spaces.

        A run of one short fragment is walked over as one; a feature may end with its first or its last. Where a walk comes to a
        word as if it had started there, the later start goes: the longer run has all its readings.
        """
        again = np.zeros(len(code), bool)
        again[1:] = single[code[1:]] & (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        kept = np.flatnonzero(~again)
        last = np.append(kept[1:], len(code)) - 1
        code_at, owner_at = code[kept], owner[kept]
        first = start[code_at]
        at = np.flatnonzero(first >= 0)
        begin, walked = at, first[at]
        texts: list[int] = []
        found: list[int] = []
        while len(at):
            inside = at + 1 < len(kept)
            begin, at, walked = begin[inside], at[inside] + 1, walked[inside]
            inside = (owner_at[at] == owner_at[begin]) & partial[code_at[at]]
            begin, at, walked = begin[inside], at[inside], walked[inside]
            pairs, where = np.unique(walked * len(words) + code_at[at], return_inverse=True)
            walked = np.array([self._step(int(p) // len(words), words[int(p) % len(words)]) for p in pairs], np.int64)[where]
            on = walked >= 0
            begin, at, walked = begin[on], at[on], walked[on]
            covered = np.unique(at[first[at] == walked])
            if len(covered):
                on = ~np.isin(begin, covered)
                begin, at, walked = begin[on], at[on], walked[on]
            ends = [self.walked[w][1] for w in walked.tolist()]
            for i in np.flatnonzero(np.array(ends, bool)):
                low = kept[begin[i]]
                for high in {int(kept[at[i]]), int(last[at[i]])}:
                    feature = self._feature(" ".join([words[c] for c in code[low : high + 1]]).lower())
                    if feature >= 0:
                        texts.append(int(owner_at[at[i]]))
                        found.append(feature)
        return texts, found

    def find(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The distinct features of each text, as pairs of text and feature, in order."""
        import pyarrow.compute as pc

        if max(len(self.seen), len(self.decoded), len(self.steps), len(self.restored)) > CACHE_WORDS:
            self._forget()
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        partial, feature, start, single = np.zeros(len(words), bool), np.full(len(words), -1), np.full(len(words), -1), np.zeros(len(words), bool)
        text_stem, stem = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if words and self.n > 1:
            near, stemmed = self._partial(words)
            text_stem, stem = self._stemmed(words, stemmed, code, owner)
            partial[near] = True
            for i in near.tolist():
                feature[i], _, start[i], single[i] = self._word(words[i])
        feature = feature[code]
        hit = np.flatnonzero(feature >= 0)
        text, over = self._joined(words, code, owner, start, single, partial)
        n = self.n
        both = np.unique(np.concatenate([owner[hit] * n + feature[hit], np.array(text, np.int64) * n + np.array(over, np.int64), text_stem * n + stem]))
        return both // n, both % n


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5


def _restored(model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        restorer = Restorer(model.value)
        for batch in batches:
            words = [sorted({w for w in restorer.words(t or "") if w}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["label", "text", "words"])

    return run


def fit(rows: list[tuple[int, list[int]]], n: int, strength: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by Newton steps on n binary features."""
    x = np.zeros((len(rows), n + 1), np.float64)
    y = np.array([label for label, _ in rows], np.float64)
    for i, (_, features) in enumerate(rows):
        x[i, features] = 1
    x[:, n] = 1
    w = np.zeros(n + 1)
    penalty = np.full(n + 1, strength)
    penalty[n] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:n], float(w[n]) - best_cut(x @ w, y)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The value that parts ones from zeros with the fewest errors; of equally good places the middle of the widest gap. Penalised
    weights are too small for rows with a single telling feature, so 0 would miss them."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.append(0, np.cumsum(y))[1:-1] + (len(y) - y.sum() - np.cumsum(1 - y))[:-1]  # ones below, zeros above
    gaps = np.diff(z)
    places = np.flatnonzero(gaps > 1e-9)
    if not len(places):
        return 0.0
    best = places[errors[places] == errors[places].min()]
    at = best[np.argmax(gaps[best])]
    return float(z[at] + z[at + 1]) / 2


class Toxicity:
    """``scored``: doc_id, held_out, score, predicted of every document."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        self.model = character_model(docs, text_col)
        model = spark.sparkContext.broadcast(self.model)
        known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
        chosen = sampled(known.groupBy("doc_id").agg(F.max("toxic").alias("label")), TRAIN_ROWS, "doc_id")
        sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int").alias("label"), "text")
        train = stage(sample.mapInArrow(_restored(model), "label int, text string, words array<string>").withColumn("row", F.monotonically_increasing_id()), "toxic-train")
        totals = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        good, bad = totals.get(0, 0), totals.get(1, 0)
        self.vocabulary: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.weights, self.bias = np.zeros(0), math.log(bad / good) if good and bad else (30.0 if bad else -30.0)
        if good and bad:
            words = train.select("row", "label", F.explode("words").alias("word"))
            odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
            count = lambda rows: rows.groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).where(F.col("bad") + F.col("good") >= MIN_DOCS)
            best = lambda counted, n: [r.word for r in counted.withColumn("gain", F.col("bad") * odds).where("gain > 0").orderBy(F.desc("gain"), "word").limit(n).collect()]
            counts = count(words)
            self.vocabulary = {word: i for i, word in enumerate(best(counts, FEATURES))}
            sized = F.transform(F.sequence(F.lit(STEM_LENGTHS.start), F.least(F.length("word"), F.lit(STEM_LENGTHS.stop - 1))), lambda k: F.substring(F.col("word"), F.lit(1), k))
            heads = words.where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= STEM_LENGTHS.start)).select("row", "label", F.explode(sized).alias("word"))
            several = heads.groupBy("row", "label", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= STEM_WORDS)
            self.stems = {stem: len(self.vocabulary) + i for i, stem in enumerate(best(count(several), STEMS))}
        #: Words of the sample, in MIN_DOCS of its rows, that have a feature's skeleton and are none.
        self.known: set[str] = set()
        if self.vocabulary or self.stems:
            same = F.regexp_replace(F.translate("word", "l", "i"), r"(.)\1+", "$1")
            plain = counts.where(F.col("word").rlike(r"^\p{L}+$") & same.isin(*{skeleton(w) for w in self.vocabulary})).select("word")
            self.known = {r.word for r in plain.collect()} - self.vocabulary.keys()
            found = train.select("label", "text").mapInArrow(self._found(model), "label int, features array<int>")
            self.weights, self.bias = fit([(r.label, r.features) for r in found.collect()], len(self.vocabulary) + len(self.stems))  # TRAIN_ROWS at most
        drop(train)
        self.scored = self._score(docs, model, id_col, text_col)

    def _found(self, model):
        """The features of the sample's texts, found as in scoring."""
        features, known, stems = self.vocabulary, self.known, self.stems

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            scorer = Scorer(model.value, features, known, stems)
            for batch in batches:
                for a, b, texts in text_chunks(batch.column(1), TEXT_BYTES, lambda c: c):
                    text, feature = scorer.find(texts)
                    own = [x.tolist() for x in np.split(feature, np.searchsorted(text, np.arange(1, b - a)))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.list_(pa.int32()))], names=["label", "features"])

        return run

    def _score(self, docs: DataFrame, model, id_col: str, text_col: str) -> DataFrame:
        features, known, stems, weights, bias = self.vocabulary, self.known, self.stems, self.weights, self.bias

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            scorer = Scorer(model.value, features, known, stems)
            for batch in batches:
                total = np.full(batch.num_rows, bias)
                if features or stems:
                    for low, _, texts in text_chunks(batch.column(1), TEXT_BYTES, lambda c: c):
                        text, feature = scorer.find(texts)
                        np.add.at(total, low + text, weights[feature])
                scores = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

        schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
        scored = docs.select(id_col, text_col).mapInArrow(run, schema)
        return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
