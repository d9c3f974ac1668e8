"""Language ID by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary: its pieces of letters, without case,
``WORD`` standing before those that begin a word. Each language has a probability
for every piece. A word's probability is the sum over all its segmentations into
pieces (forward algorithm); letters the vocabulary lacks stand for themselves at
``UNKNOWN``. Piece probabilities are fitted by expectation-maximisation on the
counts of words per language (forward-backward). A text goes to the language with
the highest mean log probability per word; ``score`` is that language's share when
all languages are equally likely and a text counts as at most ``EVIDENCE`` words.

Words are maximal runs of letters of the lower-cased text, however long, and pieces as
long as the vocabulary has them. Words of at most ``LONGEST`` letters go through the
lattice together; a longer one (a script without spaces) goes alone, ``CHUNK`` letters at
a time, and the state of the sums is carried from one chunk to the next. It counts as one
word for every ``LONGEST`` letters. Whole texts count.

``score`` compares the learned languages only. Whether a text is in any of them is told by
``fit``: the best language's log probability less that of a background of single letters
(their shares over all languages), per letter. The language's ``floor`` for it is ``SHARE``
of the mean over the words it has learned, less ``NOISE`` standard deviations of what a text
of so many letters varies by chance.

Defined cases: null texts and texts without a letter get ``und`` and score 0, as
does every text if no row has a language to learn; null languages do not learn;
ties go to the first language in order; repeated rows count as often as they
stand; an empty table gives an empty result; other columns pass where kept.

Scale: counts of words are summed within tasks, then by Spark; each EM step reads
that table only and sums one row per language, piece and task. A model has
vocabulary x languages numbers; languages beyond ``LANGUAGES_AT_ONCE`` are fitted
and scored in further groups, one pass each, so the broadcast keeps its bound."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, schema_of, send
from .words import mix, row_sums, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = "▁"  # the vocabulary's sign before a piece that begins a word
LONGEST, CHUNK = 32, 4096
UNKNOWN = 1e-7
STEPS = 2
EVIDENCE = 20
SHARE, NOISE = 0.5, 3.0
LANGUAGES_AT_ONCE = 64
HELD_WORDS = 300_000
ADDED = ("lang_pred", "score", "fit", "floor")
BATCH_WORDS = 20_000
_R = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters, in order, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k).lower()
        body = piece.removeprefix(WORD)
        if body.isalpha():
            found[piece] = None
    return sorted(found)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


class Pieces:
    """Finds vocabulary pieces in many words at once, by hashes of their letters."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        keys = self._hashes(pieces)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.size = len(pieces)
        self.near = np.zeros(1 << 20, bool)
        self.near[keys >> np.uint64(44)] = True

    def _hashes(self, pieces: list[str]) -> np.ndarray:
        size = np.array([len(p) for p in pieces])
        text = "".join(p.ljust(self.longest, "\0") for p in pieces)
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters = letters.reshape(len(pieces), self.longest).astype(np.uint64)
        h = np.zeros(len(pieces), np.uint64)
        for k in range(self.longest):
            h = np.where(k < size, (h + letters[:, k] + np.uint64(1)) * _R, h)
        return mix(h)

    def lattice(self, words: list[str], at_once: int = BATCH_WORDS
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For words of one length after another, up to ``LONGEST`` letters: their indices,
        and ids[length - 1, word, end]: the piece that ends there, ``size`` for an unknown
        letter, -1 for none."""
        lengths = np.array([len(w) for w in words], np.int64) + 1
        order = np.argsort(lengths, kind="stable")
        order = order[:np.searchsorted(lengths[order], LONGEST + 1, "right")]
        if not len(order):
            return
        bounds = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0, True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            for at in range(a, b, at_once):
                some = order[at:min(at + at_once, b)]
                n = int(lengths[some[0]])
                text = "".join(WORD + words[i] for i in some)
                letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                yield some, self._ids(letters.reshape(len(some), n))

    def chunks(self, word: str) -> Iterator[np.ndarray]:
        """The ids of one long word, [length - 1, end], for some ends after others."""
        letters = np.frombuffer((WORD + word).encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(letters), CHUNK):
            back = min(at, self.longest - 1)
            ids = self._ids(letters[None, at - back:at + CHUNK])[:, 0, back:]
            yield np.pad(ids, ((0, self.longest - len(ids)), (0, 0)), constant_values=-1)

    def _ids(self, letters: np.ndarray) -> np.ndarray:
        rows, n = letters.shape
        code = letters.astype(np.uint64) + np.uint64(1)
        most = min(self.longest, n)
        ids = np.full((most, rows, n), -1, np.int32)
        h = np.zeros((rows, n), np.uint64)
        for size in range(1, most + 1):  # h[:, k]: letters k .. k + size - 1
            h = (h[:, :n - size + 1] + code[:, size - 1:]) * _R
            key = mix(h)
            row, begin = np.nonzero(self.near[key >> np.uint64(44)])
            key = key[row, begin]
            at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
            hit = self.keys[at] == key
            ids[size - 1, row[hit], begin[hit] + size - 1] = self.order[at[hit]]
            if size == 1:
                ids[0][ids[0] < 0] = self.size
        return ids


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[end, word, language]: summed probability of all segmentations of the
    first ``end`` letters. ``p``: pieces (and the unknown letter) x languages."""
    most, rows, n = ids.shape
    alpha = np.zeros((n + 1, rows, p.shape[1]))
    alpha[0] = 1.0
    some = (ids >= 0).any(axis=1)
    for end in range(1, n + 1):
        for size in (np.flatnonzero(some[:end, end - 1]) + 1).tolist():
            piece = ids[size - 1, :, end - 1]
            at = np.flatnonzero(piece >= 0)
            alpha[end, at] += alpha[end - size, at] * p[piece[at]]
    return alpha


class Carried:
    """The forward sums of one long word, in proportion to the last one: ``before[k]`` is
    the sum k letters back over the sum here. ``log`` is the logarithm of the sum here."""

    def __init__(self, longest: int, languages: int):
        self.before = np.zeros((longest, languages))
        self.before[0] = 1.0
        self.log = np.zeros(languages)

    def step(self, pieces: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Goes on by a letter. ``pieces``: the piece of each length that ends there or -1.
        Returns the lengths (less 1) that have one, and their shares of the sum."""
        size = np.flatnonzero(pieces >= 0)
        part = self.before[size] * p[pieces[size]]
        total = part.sum(axis=0)
        self.log += np.log(total)
        self.before[1:] = self.before[:-1] / total
        self.before[0] = 1.0
        return size, part / total


def long_word(finder: "Pieces", word: str, p: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length by language."""
    state = Carried(finder.longest, p.shape[1])
    for ids in finder.chunks(word):
        for pieces in ids.T:
            state.step(pieces, p)
    return state.log


def expected_in_long(finder: "Pieces", word: str, p: np.ndarray, weight: float,
                     into: np.ndarray) -> None:
    """``expected`` for one word of any length; p and into: one language's pieces."""
    state, steps = Carried(finder.longest, 1), []
    for ids in finder.chunks(word):
        for pieces in ids.T:
            size, share = state.step(pieces, p[:, None])
            steps.append((size, pieces[size], share[:, 0]))
    ends = np.zeros(len(steps) + 1)  # how likely a piece ends there
    ends[-1] = 1.0
    for end in range(len(steps), 0, -1):
        size, piece, share = steps[end - 1]
        flow = ends[end] * share
        ends[end - 1 - size] += flow
        np.add.at(into, piece, weight * flow)


def expected(ids: np.ndarray, p: np.ndarray, language: np.ndarray, weight: np.ndarray,
             into: np.ndarray) -> None:
    """Adds to ``into`` (pieces x languages) how often each piece is expected in the
    words, each of one language and so many times there."""
    most, rows, n = ids.shape
    alpha, beta = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
    alpha[0], beta[n] = 1.0, 1.0
    some = (ids >= 0).any(axis=1)
    for end in range(1, n + 1):
        for size in (np.flatnonzero(some[:end, end - 1]) + 1).tolist():
            piece = ids[size - 1, :, end - 1]
            at = np.flatnonzero(piece >= 0)
            alpha[end, at] += alpha[end - size, at] * p[piece[at], language[at]]
    scale = weight / alpha[n]
    for end in range(n, 0, -1):
        for size in (np.flatnonzero(some[:end, end - 1]) + 1).tolist():
            piece = ids[size - 1, :, end - 1]
            at = np.flatnonzero(piece >= 0)
            flow = p[piece[at], language[at]] * beta[end, at]
            beta[end - size, at] += flow
            np.add.at(into, (piece[at], language[at]), alpha[end - size, at] * flow * scale[at])


def count_words(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, word, n: how often the words of each language stand in the texts."""
    src = docs.select(F.col(lang).alias("lang"), F.col(text).alias("__text"))
    schema = "lang string, word string, n long"

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for language, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(counts), pa.string()),
                 pa.array(list(counts), pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for language, value in zip(b.column("lang").to_pylist(),
                                       b.column("__text").to_pylist()):
                if value:
                    held.setdefault(language, Counter()).update(words_of(value))
                    if sum(map(len, held.values())) > HELD_WORDS:
                        yield from emit(held)
                        held = {}
        yield from emit(held)

    return src.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """``p``: piece probabilities by language, the unknown letter's last. ``letters`` and
    ``shares``: the background, sorted code points and log shares (``unseen`` for others).
    ``least`` and ``noise``: a language's floor is ``least - noise / sqrt(letters)``."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray,
                 letters: np.ndarray, shares: np.ndarray, unseen: float):
        self.pieces, self.languages, self.p = pieces, languages, p
        self.letters, self.shares, self.unseen = letters, shares, unseen
        self.least, self.noise = np.full((2, len(languages)), np.nan)

    def background(self, words: list[str]) -> np.ndarray:
        """Log probability of each word's letters by themselves."""
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, code), max(len(self.letters) - 1, 0))
        known = self.letters[at] == code if len(self.letters) else np.zeros(len(code), bool)
        logs = np.where(known, self.shares[at] if len(self.letters) else 0.0, self.unseen)
        return row_sums(logs, np.r_[0, np.cumsum(size)])


def letter_shares(words: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Code points of the learned words, the logarithms of their shares and of an unseen
    letter's: once in all, and no less than an unknown one has in a model, so that strange
    letters speak for no language. The driver gets one number per letter of the scripts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            text = b.column("word").to_pylist()
            code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
            times = np.repeat(b.column("n").to_numpy(), [len(w) for w in text])
            letter, which = np.unique(code, return_inverse=True)
            total.update(dict(zip(letter.tolist(), np.bincount(which, times, len(letter)))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())],
            names=["letter", "n"])

    rows = (words.select("word", "n").mapInArrow(run, "letter int, n double")
            .groupBy("letter").agg(F.sum("n").alias("n")).orderBy("letter").toPandas())
    n = rows["n"].to_numpy(float)
    unseen = max(-np.log(n.sum() + 1), np.log(UNKNOWN))
    return (rows["letter"].to_numpy(np.uint32),
            np.maximum(np.log(n / n.sum()), unseen) if len(n) else n, float(unseen))


def fit(docs: DataFrame, pieces: list[str], scratch: Scratch, lang: str = "lang",
        text: str = "text", steps: int = STEPS, fits: bool = False) -> list[Model]:
    """Models of all non-null languages, in groups of LANGUAGES_AT_ONCE; with ``fits``
    they have floors."""
    docs = docs.where(F.col(lang).isNotNull())
    words = scratch.write(count_words(docs, lang, text), "words")
    names = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    models, background = [], letter_shares(words)
    for k in range(0, len(names), LANGUAGES_AT_ONCE):
        group = names[k:k + LANGUAGES_AT_ONCE]
        start = np.full((len(pieces) + 1, len(group)), 1.0 / len(pieces))
        start[-1] = UNKNOWN
        model = Model(pieces, group, start, *background)
        for _ in range(steps):
            model = em_step(words.where(F.col("lang").isin(group)), model)
        if fits:
            set_floors(words.where(F.col("lang").isin(group)), model)
        models.append(model)
    scratch.drop("words")
    return models


def em_step(words: DataFrame, model: Model) -> Model:
    spark = words.sparkSession
    sent = send(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        finder, into = Pieces(m.pieces), np.zeros(m.p.shape)
        number = {name: k for k, name in enumerate(m.languages)}
        for b in batches:
            text = b.column("word").to_pylist()
            language = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            weight = b.column("n").to_numpy().astype(float)
            for some, ids in finder.lattice(text):
                expected(ids, m.p, language[some], weight[some], into)
            for k, word in enumerate(text):
                if len(word) > LONGEST:
                    one = language[k]
                    expected_in_long(finder, word, m.p[:, one], weight[k], into[:, one])
        piece, language = np.nonzero(into)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(language, pa.int32()),
             pa.array(into[piece, language])], names=["piece", "language", "n"])

    sums = (words.mapInArrow(run, "piece int, language int, n double")
            .groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas())
    n = np.zeros(model.p.shape)
    n[sums["piece"], sums["language"]] = sums["n"]
    n[-1] = 0  # unknown letters keep their fixed probability
    p = (n + 0.01) / (n + 0.01).sum(axis=0)
    p[-1] = UNKNOWN
    return Model(model.pieces, model.languages, p, model.letters, model.shares, model.unseen)


def word_logs(finder: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word by language."""
    logs = np.zeros((len(words), p.shape[1]))
    # Sums are held per word and language: fewer words where there are many.
    for some, ids in finder.lattice(words, 4 * BATCH_WORDS // max(4, p.shape[1])):
        logs[some] = np.log(forward(ids, p)[-1])
    for k, word in enumerate(words):
        if len(word) > LONGEST:
            logs[k] = long_word(finder, word, p)
    return logs


def set_floors(words: DataFrame, model: Model) -> None:
    """The floors of a model's languages, from their learned words: one pass, six sums a
    language."""
    sent = send(words.sparkSession, model)
    names = [f"s{k}" for k in range(6)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        finder, sums = Pieces(m.pieces), np.zeros((6, len(m.languages)))
        number = {name: k for k, name in enumerate(m.languages)}
        for b in batches:
            text = b.column("word").to_pylist()
            language = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            gain = word_logs(finder, text, m.p)[np.arange(len(text)), language]
            gain -= m.background(text)
            size, n = np.array([len(w) for w in text], float), b.column("n").to_numpy()
            for k, x in enumerate((1, size, gain, gain * gain, gain * size, size * size)):
                sums[k] += np.bincount(language, n * x, len(m.languages))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(m.languages)), pa.int32()), *[pa.array(x) for x in sums]],
            names=["language", *names])

    rows = (words.mapInArrow(run, "language int, " + ", ".join(f"{c} double" for c in names))
            .groupBy("language").agg(*[F.sum(c).alias(c) for c in names]).toPandas())
    n, size, gain, gains, both, sizes = rows.sort_values("language")[names].to_numpy().T
    mean = gain / size
    varies = np.maximum(gains - 2 * mean * both + mean * mean * sizes, 0) / n
    model.least, model.noise = SHARE * mean, NOISE * np.sqrt(varies * n / size)


def predict(docs: DataFrame, models: list[Model], keep: tuple[str, ...] = ("doc_id",),
            text: str = "text", fits: bool = False) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row, and with ``fits`` its
    ``fit`` and the ``floor`` for it (null if ``und``); columns of these names are replaced."""
    more = ("fit", "floor") if fits else ()
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", *more))
    out = docs.select(*keep, F.col(text).alias("__text"),
                      F.lit(None).cast("string").alias("__lang"),
                      F.lit(None).cast("double").alias("__best"),
                      F.lit(None).cast("double").alias("__all"),
                      F.lit(None).cast("double").alias("fit"),
                      F.lit(None).cast("double").alias("floor"))
    for model in models:
        out = _score(out, model)
    share = F.exp(F.col("__best") - F.col("__all"))
    return out.select(*keep, F.coalesce("__lang", F.lit("und")).alias("lang_pred"),
                      F.coalesce(share, F.lit(0.0)).alias("score"), *more)


def _score(docs: DataFrame, model: Model) -> DataFrame:
    """Brings the running best language and the sum over languages up to date."""
    sent = send(docs.sparkSession, model)
    schema = schema_of(docs)
    names = ("__best", "__lang", "__all", "fit", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        finder = Pieces(m.pieces)
        place: dict[str, int] = {}  # of the words scored so far
        known, alone = np.zeros((0, len(m.languages))), np.zeros(0)
        for b in (part for whole in batches for part in slices(whole, "__text")):
            if len(place) > HELD_WORDS:
                place, known, alone = {}, np.zeros((0, len(m.languages))), np.zeros(0)
            texts = [words_of(t) if t else [] for t in b.column("__text").to_pylist()]
            fresh = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in place]
            place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
            known = np.concatenate([known, word_logs(finder, fresh, m.p)])
            alone = np.concatenate([alone, m.background(fresh)])
            best, name, total, fit, floor = (b.column(c).to_pylist() for c in names)
            for i, t in enumerate(texts):
                if not any(c.isalpha() for w in t for c in w):
                    continue
                n = len(t) + sum((len(w) - 1) // LONGEST for w in t if len(w) > LONGEST)
                at = [place[w] for w in t]
                logs = known[at].sum(axis=0)
                mean = logs * (min(n, EVIDENCE) / n)
                top = int(mean.argmax())
                if best[i] is None or mean[top] > best[i]:
                    best[i], name[i] = float(mean[top]), m.languages[top]
                    size = sum(map(len, t))
                    fit[i] = float(logs[top] - alone[at].sum()) / size
                    floor[i] = float(m.least[top] - m.noise[top] / size ** 0.5)
                own = float(np.logaddexp.reduce(mean))
                total[i] = own if total[i] is None else float(np.logaddexp(total[i], own))
            cols = [b.column(c) for c in b.schema.names[:-len(names)]]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(name, pa.string()), pa.array(best, pa.float64()),
                 pa.array(total, pa.float64()), pa.array(fit, pa.float64()),
                 pa.array(floor, pa.float64())], names=b.schema.names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, learn, keep: tuple[str, ...] = ("doc_id",), lang: str = "lang",
             text: str = "text", vocabulary: str = VOCABULARY, fits: bool = False) -> DataFrame:
    """Fits on the rows where the column ``learn`` holds, predicts every row."""
    scratch = Scratch(docs.sparkSession, "language")
    models = fit(docs.where(learn), load_pieces(vocabulary), scratch, lang, text,
                 fits=fits)
    return predict(docs, models, keep, text, fits)
