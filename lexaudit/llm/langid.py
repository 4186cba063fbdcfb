"""Language spans: script ranges narrow the candidates, Viterbi over word scores with a switching penalty labels the words."""

from __future__ import annotations

import bisect
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import held

#: Labelled documents of each language in the sample that the model is fitted on, chosen by a hash; about, and at most twice that.
SAMPLE_DOCS = 300
#: Languages that are learned: so many of the most frequent labels.
MAX_LANGS = 500
#: Nats that a change of language costs.
SWITCH = 8.0
#: Log-probability of a word under a language that is no candidate for its script.
RULED_OUT = -60.0
#: A language is a candidate for a script in which this share of its sampled letters stands.
SCRIPT_SHARE = 0.02
#: Words of a worker's cache of scores; when full it starts anew.
CACHE_WORDS = 300_000
#: Words labelled at a time.
BATCH_WORDS = 300_000
ORDER = 4
#: Log-probability of a character that no language has, and what each character of missing context costs.
UNSEEN, BACK_OFF = -16.0, 0.9
UND = "und"

#: Letter runs; very long runs are scored in pieces.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]{0,63}")
LAST = regex.compile(r"(?:[^\p{L}]*?)((?:\p{M}*)\p{L})", regex.DOTALL)

#: First code points of Unicode script ranges and the script that begins there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x30000, "Han"),
)
_STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    """The script of the first letter."""
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


@dataclass
class Model:
    """Character n-gram log-probabilities by language, and the languages of each script."""

    langs: list[str]
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    scripts: dict[str, list[int]] = field(default_factory=dict)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word under each language, no candidates of its script ruled out."""
        rows: list[int] = []
        sizes = np.empty(len(words), np.int64)
        get, none = self.grams.get, len(self.table) - 1
        pad = " " * (ORDER - 1)
        for w, word in enumerate(words):
            padded = f"{pad}{word.lower()} "
            begin = len(rows)
            for i in range(ORDER, len(padded) + 1):
                k = get(padded[i - ORDER : i])
                if k is None:
                    for n in range(ORDER - 1, 0, -1):
                        k = get(padded[i - n : i])
                        if k is not None:
                            break
                    else:
                        k = none
                rows.append(k)
            sizes[w] = len(rows) - begin
        ends = np.cumsum(sizes)
        total = np.add.reduceat(self.table[rows], ends - sizes, axis=0)
        out = np.zeros(len(self.langs), np.float32)
        masks = {s: out if len(c) == len(self.langs) else np.where(np.isin(np.arange(len(self.langs)), c), 0, RULED_OUT).astype(np.float32) for s, c in self.scripts.items()}
        return total + np.array([masks.get(script(w), out) for w in words], np.float32)


def fit(sample: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs: absolute-discount estimates of characters given up to ORDER - 1 before them."""
    langs = sorted({lang for lang, _ in sample})
    counts: list[list[dict[str, int]]] = [[defaultdict(int) for _ in range(ORDER + 1)] for _ in langs]
    letters: list[dict[str, int]] = [defaultdict(int) for _ in langs]
    where = {lang: k for k, lang in enumerate(langs)}
    for lang, text in sample:
        mine = counts[where[lang]]
        words: dict[str, int] = defaultdict(int)
        for w in WORDS.findall(text):
            words[w.lower()] += 1
        for w, c in words.items():
            letters[where[lang]][script(w)] += len(w) * c
            padded = " " * (ORDER - 1) + w + " "
            for i in range(ORDER - 1, len(padded)):
                for n in range(1, ORDER + 1):
                    mine[n][padded[i - n + 1 : i + 1]] += c
    model = Model(langs)
    every = sorted({g for mine in counts for n in range(1, ORDER + 1) for g in mine[n]})
    model.grams = {g: i for i, g in enumerate(every)}
    model.table = np.full((len(every) + 1, len(langs)), UNSEEN, np.float32)
    for k, mine in enumerate(counts):
        totals: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for n in range(1, ORDER + 1):
            for g, c in mine[n].items():
                totals[g[:-1]] += c
                kinds[g[:-1]] += 1
        prob: dict[str, float] = {}

        def p(g: str) -> float:
            if not g:
                return 1e-6
            if g in prob:
                return prob[g]
            lower = p(g[1:]) if len(g) > 1 else 1e-6
            t = totals.get(g[:-1], 0)
            out = lower if not t else (max(mine[len(g)].get(g, 0) - 0.5, 0) + 0.5 * kinds[g[:-1]] * lower) / t
            prob[g] = out
            return out

        for g, i in model.grams.items():
            model.table[i, k] = np.log(max(p(g), 1e-9)) - BACK_OFF * (ORDER - len(g))
    for s in sorted({s for x in letters for s in x}):
        model.scripts[s] = [k for k, x in enumerate(letters) if x.get(s, 0) >= SCRIPT_SHARE * max(sum(x.values()), 1)] or list(range(len(langs)))
    return model


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; words of document d follow each other, ``sizes`` of them. Ties: the smaller label stays or comes.

    All documents advance together, the longest first, so that a step is one array operation over those still running.
    """
    n, k = scores.shape
    out = np.zeros(n, np.int32)
    if not n or k == 1:
        return out
    order = np.argsort(-sizes, kind="stable")
    length, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
    steps = int(length[0])
    alive = np.searchsorted(-length, -np.arange(steps), side="left")  # documents longer than t
    came = np.zeros(n, np.int32)  # the best label one word before
    switched = np.zeros((n, k), bool)
    value = np.zeros((len(length), k), scores.dtype)
    for t in range(steps):
        m = alive[t]
        at = start[:m] + t
        now = value[:m]
        best = now.argmax(axis=1)
        other = now[np.arange(m), best] - penalty
        if t:
            came[at] = best
            move = now < other[:, None]
            switched[at] = move
            now = np.where(move, other[:, None], now)
        value[:m] = now + scores[at]
    last = value.argmax(axis=1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        at = start[:m] + t
        label = last[:m]
        out[at] = label
        last[:m] = np.where(switched[at, label], came[at], label)
    return out


def spans_of(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of words of one language: start (of the first word), end (of the last), lang."""
    if not len(labels):
        return []
    cuts = np.flatnonzero(np.diff(labels)) + 1
    firsts, lasts = {0, *cuts.tolist()}, {len(labels) - 1, *(cuts - 1).tolist()}
    out: list[dict] = []
    if not len(cuts):  # no need to visit each word: the last letter or mark ends the last word
        end = len(text) - LAST.match(text[::-1]).start(1)
        return [{"start": WORDS.search(text).start(), "end": end, "lang": langs[labels[0]]}]
    for i, m in enumerate(WORDS.finditer(text)):
        if i in firsts:
            out.append({"start": m.start(), "end": m.end(), "lang": langs[labels[i]]})
        if i in lasts:
            out[-1]["end"] = m.end()
    return out


class Labeller:
    def __init__(self, model: Model, penalty: float) -> None:
        self.model, self.penalty = model, penalty
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)

    def label(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """Language, share of the letters that it has, spans; of each text."""
        if not self.model.langs:
            return [(UND, 0.0, [])] * len(texts)
        if len(self.index) > CACHE_WORDS:
            self.clear()
        found = [WORDS.findall(x) for x in texts]
        words = [w for x in found for w in x]
        where = list(map(self.index.get, words))
        if None in where:
            new = list(dict.fromkeys(w for w, k in zip(words, where) if k is None))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.table = np.vstack([self.table, self.model.scores(new)])
            where = list(map(self.index.get, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        labels = viterbi(self.table[np.array(where, np.int64)], sizes, self.penalty)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(texts)), sizes)
        k = len(self.model.langs)
        share = np.bincount(doc * k + labels, weights=lengths, minlength=len(texts) * k).reshape(len(texts), k)
        total, best = share.sum(axis=1), share.argmax(axis=1)
        ends = np.cumsum(sizes)
        return [
            (self.model.langs[best[i]], float(share[i, best[i]] / total[i]), spans_of(x, labels[ends[i] - sizes[i] : ends[i]], self.model.langs)) if total[i] else (UND, 0.0, [])
            for i, x in enumerate(texts)
        ]


def sample_of(docs: DataFrame, train: Column, id_col: str, text_col: str, lang_col: str, sample_docs: int, max_langs: int = MAX_LANGS) -> list[tuple[str, str]]:
    """About ``sample_docs`` labelled texts of each of the ``max_langs`` most frequent languages: those whose id hashes below the share that gives so many."""
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(max_langs).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.4 * sample_docs / n))) for lang, n in sorted(counts.items())], F.lit(0.0))
    chosen = rows.where(place < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return [(r[0], r[1]) for r in sorted(chosen.limit(2 * sample_docs * len(counts)).collect())]


def identify(
    docs: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    penalty: float = SWITCH,
) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score and spans (start, end, lang; in code points).

    A bounded sample of the rows chosen by ``train`` (about ``sample_docs`` of each language, at most twice that, of at most
    MAX_LANGS languages) is taken to the driver and fits character models; only id hash, text and language of those rows are used, and nothing but the
    text enters a prediction. Each word's script leaves the languages that were seen in it; the others are ruled out unless
    none is left. Viterbi over the words' log-probabilities, with ``penalty`` for each change, labels every word of the
    whole text. lang_pred is the language of most letters (ties: first by name), score their share.

    ``und`` with score 0 and no spans: null text, no letter, or nothing to learn from. Rows are labelled one by one, without
    a shuffle. Columns named as the added ones are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"lang_pred", "score", "spans"}])
    spark = docs.sparkSession
    sample = sample_of(docs, F.lit(True) if train is None else train, id_col, text_col, lang_col, sample_docs)
    model, name = spark.sparkContext.broadcast(fit(sample)), uuid.uuid4().hex
    at = docs.columns.index(text_col)
    kept = docs.schema.names

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = held(name, lambda: Labeller(model.value, penalty))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            begin = size = 0
            for i, x in enumerate(texts):
                size += len(x or "") // 5 + 1
                if size >= BATCH_WORDS or i == len(texts) - 1:
                    got = labeller.label([y or "" for y in texts[begin : i + 1]])
                    part = batch.slice(begin, i + 1 - begin)
                    spans = pa.array([s for _, _, s in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p for p, _, _ in got], pa.string()), pa.array([s for _, s, _ in got], pa.float64()), spans], names=[*kept, "lang_pred", "score", "spans"])
                    begin, size = i + 1, 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(label, f"{schema}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
