"""Language identification: unigram pieces per language, summed over all segmentations of a word."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import written

#: Labelled documents of a language that the fit reads at most (expected number; chosen by a hash of the id).
SAMPLE = 3000
#: Rounds of expectation and maximisation.
ROUNDS = 3
#: Letters of a piece and of a stretch that is segmented as a whole; longer words are cut into stretches.
PIECE, STRETCH = 16, 32
#: Smoothing: pseudo-counts of each piece, and probability of a letter that is no piece.
PSEUDO, STRANGE = 0.05, 1e-7
UNKNOWN = "und"
KEPT_WORDS = 250_000
WORD = regex.compile(r"\p{L}+")


def public_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model made of letters and at most a leading word mark, in lower case."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in pieces if regex.fullmatch(r"▁?\p{L}*", p) and 0 < len(p) <= PIECE})


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case behind a word mark."""
    return WORD.findall(text.lower())


def stretches(word: str) -> list[str]:
    marked = "▁" + word
    return [marked[i:i + STRETCH] for i in range(0, len(marked), STRETCH)]


class Lattice:
    """All segmentations of many stretches at once: ``ids[w, e, k]`` is the piece of length k + 1 that ends at e, the
    size of the vocabulary for a strange letter, one more for none."""

    def __init__(self, index: dict[str, int], parts: list[str]):
        self.none = len(index) + 1
        self.sizes = np.array([len(p) for p in parts])
        top = int(self.sizes.max(initial=0))
        self.ids = np.full((len(parts), top + 1, PIECE), self.none, np.int32)
        get = index.get
        for w, p in enumerate(parts):
            n = len(p)
            row = self.ids[w]
            for e in range(1, n + 1):
                row[e, 0] = get(p[e - 1:e], self.none - 1)
                for k in range(1, min(PIECE, e)):
                    i = get(p[e - k - 1:e])
                    if i is not None:
                        row[e, k] = i

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """``probs``: by piece (with a row for strange letters and one of zeros) and language."""
        n, top = self.ids.shape[:2]
        alpha = np.zeros((n, top, probs.shape[1]))
        alpha[:, 0] = 1
        for e in range(1, top):
            for k in range(min(PIECE, e)):
                hit = np.flatnonzero(self.ids[:, e, k] != self.none)
                if len(hit):
                    alpha[hit, e] += alpha[hit, e - k - 1] * probs[self.ids[hit, e, k]]
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.sizes)), self.sizes]

    def expected(self, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, with ``weight`` of each stretch and language."""
        n, top = self.ids.shape[:2]
        alpha = self.forward(probs)
        beta = np.zeros_like(alpha)
        beta[np.arange(n), self.sizes] = weight / np.maximum(self.total(alpha), 1e-300)
        out = np.zeros_like(probs)
        for e in range(top - 1, 0, -1):
            for k in range(min(PIECE, e)):
                hit = np.flatnonzero(self.ids[:, e, k] != self.none)
                if len(hit):
                    i = self.ids[hit, e, k]
                    back = beta[hit, e] * probs[i]
                    np.add.at(out, i, alpha[hit, e - k - 1] * back)
                    beta[hit, e - k - 1] += back
        return out


class Model:
    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs
        self.index: dict[str, int] | None = None

    def load(self) -> Model:
        if self.index is None:
            self.index = {p: i for i, p in enumerate(self.pieces)}
            self.at: dict[str, int] = {}
            self.scores = np.zeros((1024, len(self.languages)))
        return self

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "probs": self.probs, "index": None}

    def learn(self, words: list[str]) -> None:
        """Adds the log probability of each word, in each language, to what is kept."""
        for a in range(0, len(words), 2048):
            some = words[a:a + 2048]
            parts, owner = [], []
            for w, word in enumerate(some):
                for s in stretches(word):
                    parts.append(s)
                    owner.append(w)
            lattice = Lattice(self.index, parts)
            logs = np.log(np.maximum(lattice.total(lattice.forward(self.probs)), 1e-300))
            sums = np.zeros((len(some), len(self.languages)))
            np.add.at(sums, owner, logs)
            n = len(self.at)
            while n + len(some) > len(self.scores):
                self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            self.scores[n:n + len(some)] = sums
            self.at.update(zip(some, range(n, n + len(some))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.at) > KEPT_WORDS:
            self.at.clear()
        cut = [words_of(t) if t else [] for t in texts]
        self.learn(list(set().union(*cut).difference(self.at)))
        langs, scores = [], []
        for c in cut:
            if not c or not self.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.languages[best])
            scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
        return langs, scores


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language, from labelled documents that are not held out.

    ``sample`` bounds the documents of a language (in expectation, by a hash of the id). Their words are counted by
    language, and each round spreads every word over its segmentations; the sums (languages times pieces) are all
    that the driver sees. Null texts, labels and ids teach nothing; without labels the model knows no language.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out("id"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    probs = np.full((len(pieces) + 2, len(languages)), 1.0 / max(1, len(pieces)))
    probs[-2], probs[-1] = STRANGE, 0
    if not languages:
        return Model([], pieces, probs)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)

    def count(batches):
        for b in batches:
            counts: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                counts.update((lang, s) for w in words_of(text) for s in stretches(w))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                              pa.array(counts.values(), pa.int64())], ["lang", "part", "n"])

    words = written(chosen.select("lang", "text").mapInArrow(count, "lang string, part string, n long")
                    .groupBy("lang", "part").agg(F.sum("n").alias("n")), "words")
    spark = docs.sparkSession
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Model(languages, pieces, probs))

        def expect(batches):
            m = model.value.load()
            sums = np.zeros_like(m.probs)
            place = {lang: i for i, lang in enumerate(m.languages)}
            for b in batches:
                for a in range(0, b.num_rows, 2048):
                    lang, part, n = (b.column(c).slice(a, 2048).to_pylist() for c in ("lang", "part", "n"))
                    weight = np.zeros((len(part), len(place)))
                    weight[np.arange(len(part)), [place[x] for x in lang]] = n
                    sums += Lattice(m.index, part).expected(m.probs, weight)
            for i in range(len(place)):
                hit = np.flatnonzero(sums[:-2, i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i), pa.int32()), pa.array(hit, pa.int32()),
                                                  pa.array(sums[hit, i], pa.float64())], ["lang", "piece", "uses"])

        rows = (words.coalesce(32).mapInArrow(expect, "lang int, piece int, uses double")
                .groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas())
        uses = np.full((len(pieces), len(languages)), PSEUDO)
        np.add.at(uses, (rows["piece"].to_numpy(), rows["lang"].to_numpy()), rows["uses"].to_numpy())
        probs = np.vstack([uses / uses.sum(axis=0), np.full(len(languages), STRANGE), np.zeros(len(languages))])
        model.unpersist()
    return Model(languages, pieces, probs)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    Every word of the whole text counts: its probability in a language is the sum over all its segmentations into
    pieces. ``score`` is the share of the best language, all being equally likely before; ties go to the first name.
    A text that is null or has no letter is ``und`` with score 0; so is every text if the model knows no language.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]
    schema = type(docs.schema)(kept).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value.load()
        for whole in batches:
            for b in slices(whole, text_col, 2 << 20):
                langs, scores = m.predict(b.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(langs, pa.string()),
                                                  pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
