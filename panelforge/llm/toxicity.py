"""Toxicity of texts that may be disguised: noisy-channel restoration, then a linear score of the restored words.

The channel writes a letter as itself or as a look-alike (leetspeak), repeats it, puts marks between letters, or spaces a
word out. A token that shows such traces becomes a character lattice; a beam Viterbi search under a trigram character
model gives its likeliest readings, and known words are preferred by their frequency. The character model counts every
word of every text; the known words are those that make up one in FREQUENT words or more, the score's own words, and every
word of the corpus that carries one of the score's signs.

The score is logistic in the presence of signs: restored words and their first PREFIXES letters (families of inflected
words share them). It learns from SAMPLE labelled texts at most (the first by a
hash of doc_id) outside the held-out fold. Its signs are those most indicative in that sample.

Defined cases: a null or empty text gets the score of a text without any of the words; rows without a label are only
scored; several labels of one doc_id count as toxic if any is; rows are kept one for one; a sample without both classes
gives the share of toxic rows as every score (0 when there are none); a null doc_id is not held out and never learned
from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled texts that the score learns from, at most.
SAMPLE = 10_000
#: Signs of the score, toxic texts of the sample that a sign must be in, and its least log-odds.
SIGNS, FEWEST, LEAST_ODDS = 400, 6, 1.0
PREFIXES = (4, 5, 6)
#: Share of its own log-odds that a sign's weight is held to, and how firmly (toxicity_settings.py chooses these).
PRIOR, RIDGE = 0.55, 0.03
#: A word is frequent, so that a reading may be it, from one in so many words on; so there are that many at most.
FREQUENT = 200_000
BEAM = 24
#: Of a token with more letters than any known word, so many signs are read: longer than any beginning that is weighed.
HEAD = 64
#: Signs of a spaced-out word inside a longer run of single signs, at most: longer than the known words.
SPREAD = 20
#: Tokens a worker remembers: a bound on its memory alone, not on what is read.
MEMORY = 60_000
#: Distinct words that a task counts before it passes its counts on.
COUNTED = 200_000

#: Letters that look like a sign.
#: The second table holds Cyrillic and Greek letters that look like Latin ones; they count in words that mix scripts.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
FOREIGN = {"а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u"}
LOOKALIKES |= FOREIGN
#: Costs, in nats, of a look-alike, a mark between letters, and a repeated letter.
SWAP, MARK, REPEAT = 1.5, 1.2, 1.0
#: What a known word is worth beside its characters.
KNOWN = 4.0

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NOISE = re.compile(r"^([\W_])\1{2,}|([\W_])\2{2,}$|^[\"'(\[{«„“]+|[.,;:?\"')\]}»“”…]+$")
TRACES = re.compile(r"[^\W\d_]*(?:[\W\d_]|([^\W\d_])\1\1)")
DOUBLED = re.compile(r"([^\W\d_])\1")
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: Of a sign that stands more often in a row, so many are read: each one more costs every reading the same.
RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Marks at a token's ends that are no part of a word.
OUTER = "\"'([{«„“.,;:?)]}»”…"
MIXED = re.compile(f"(?=.*[a-z]).*[{''.join(FOREIGN)}]")

RESULT = "doc_id long, held_out boolean, score double, predicted int"


def signs_of(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)] if word else []


@dataclass
class CharModel:
    """Trigram counts of characters in words, with backing-off to shorter contexts."""

    trigrams: dict[str, int]
    pairs: Counter = field(default_factory=Counter)
    singles: Counter = field(default_factory=Counter)
    contexts: Counter = field(default_factory=Counter)
    total: int = 0

    def __post_init__(self) -> None:
        for g, n in self.trigrams.items():
            self.contexts[g[:2]] += n
            self.pairs[g[1:]] += n
            self.singles[g[2]] += n
            self.total += n
        self.firsts = Counter()
        for g, n in self.pairs.items():
            self.firsts[g[0]] += n
        self.known: dict[str, float] = {}

    def cost(self, context: str, letter: str) -> float:
        """Minus the log-probability of a letter after two others."""
        g = context + letter
        got = self.known.get(g)
        if got is None:
            single = (self.singles.get(letter, 0) + 0.5) / (self.total + 100)
            pair = (self.pairs.get(g[1:], 0) + 20 * single) / (self.firsts.get(g[1], 0) + 20)
            got = self.known[g] = -math.log((self.trigrams.get(g, 0) + 20 * pair) / (self.contexts.get(context, 0) + 20))
        return got


@dataclass
class Restorer:
    """Readings of disguised tokens."""

    model: CharModel
    lexicon: dict[str, int]

    def __post_init__(self) -> None:
        self.most = max(self.lexicon.values(), default=1)
        self.longest = max(map(len, self.lexicon), default=0)
        self.memory: dict[str, str] = {}

    def read(self, token: str) -> str:
        """The likeliest word behind a lower-case token without outer marks."""
        beam = {("", "^^"): (0.0, "")}
        for sign in token:
            options = ([(sign, 0.0)] if sign.isalpha() else []) + [(c, SWAP) for c in LOOKALIKES.get(sign, "")]
            grown: dict[tuple[str, str], tuple[float, str]] = {}
            for (word, context), (cost, last) in beam.items():
                moves = [(word + c, context[1] + c, cost + extra + self.model.cost(context, c), c) for c, extra in options]
                moves += [(word, context, cost + REPEAT + extra, last) for c, extra in options if c == last]
                if not sign.isalpha():
                    moves.append((word, context, cost + (MARK if not options else 2 * MARK + SWAP), last))
                for w, k, c, b in moves:
                    if c < grown.get((w, k), (math.inf, ""))[0]:
                        grown[w, k] = (c, b)
            beam = dict(sorted(grown.items(), key=lambda x: (x[1][0], x[0]))[:BEAM])
        best, least = token, math.inf
        for (word, context), (cost, _) in beam.items():
            if not word:
                continue
            cost += self.model.cost(context, "$")
            if word in self.lexicon:
                cost -= KNOWN + len(word) * (1 + 0.5 * math.log1p(self.lexicon[word]) / math.log1p(self.most))
            if (cost, word) < (least, best):
                best, least = word, cost
        return best

    def restore(self, token: str) -> str:
        """A token's word: outer marks go, and one with traces of the channel is read."""
        got = self.memory.get(token)
        if got is None:
            core = NOISE.sub("", NOISE.sub("", token))
            plain = core if core.isalpha() else EDGE.sub("", core)
            traced = not core.isalpha() or TRACES.match(core) or (not core.isascii() and MIXED.match(core))
            if plain in self.lexicon or len(core) < 3 or not (self.disguised(core) if traced else DOUBLED.search(core)):
                got = plain
            elif len(core) > HEAD and self.fewest(core) > self.longest:
                # too many letters for a known word, so what it can carry are beginnings
                got = self.read(RUN.sub(r"\1\1\1", core[:HEAD])) if traced and self.lettered(core) else plain
            else:
                got = self.read(RUN.sub(r"\1\1\1", core))
                if got not in self.lexicon and not (traced and self.lettered(core)):
                    got = plain  # so little of a disguise must lead to a known word
            if len(self.memory) > MEMORY:
                self.memory.clear()
            if len(token) <= 100:
                self.memory[token] = got
        return got

    @staticmethod
    def fewest(core: str) -> int:
        """Letters that every reading of a token has, at least."""
        return sum(a != b and b.isalpha() for a, b in pairwise("\0" + core))

    def disguised(self, core: str) -> bool:
        """Whether a token may hide a word: letters, or signs that look like letters, make up at least half of it."""
        letters = sum(c.isalpha() for c in core)
        like = sum(c in LOOKALIKES for c in core)
        return letters >= 1 and 2 * (letters + like) >= len(core)

    def lettered(self, core: str) -> bool:
        """Whether a token's own letters carry a reading that isn't a known word."""
        return sum(c.isalpha() for c in core) >= 2 or sum(c in LOOKALIKES for c in core) <= 3

    def words(self, text: str) -> set[str]:
        """The restored words of a text."""
        low = text.lower()
        return set(map(self.restore, set(low.split()))).union(self.spread(low))

    def spread(self, low: str) -> list[str]:
        """Known words among single signs parted by spaces."""
        out = []
        for m in SPACED.finditer(low):
            signs = m[0].split()
            if sum(s.isalpha() for s in signs) * 2 >= len(signs):
                out += self.spaced("".join(signs))
        return out

    def spaced(self, run: str) -> list[str]:
        """Known words in a run of single signs: the whole run, else the longest found from the left."""
        whole = self.restore(run)
        if whole in self.lexicon:
            return [whole]
        out, at = [], 0
        while at < len(run):
            for to in range(min(len(run), at + SPREAD), at + 2, -1):
                word = self.restore(run[at:to])
                if word in self.lexicon and len(word) > 2:
                    out.append(word)
                    at = to
                    break
            else:
                at += 1
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): how often each word of letters only occurs in all texts, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(text.lower().split())
            if len(count) > COUNTED:
                yield made()
                count.clear()
        yield made()

    words = docs.select(common.text_of().alias("text")).mapInArrow(common.each(run), "word string, n long")
    words = words.withColumn("word", F.regexp_replace("word", r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")).filter(F.rlike("word", F.lit(r"^\p{L}{1,40}$")))
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def char_model(words: DataFrame) -> CharModel:
    """The trigram model of counted words, from all trigrams that occur."""
    marked = F.concat(F.lit("^^"), "word", F.lit("$"))
    grams = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(marked, i, F.lit(3)))).alias("g"))
    table = grams.groupBy("g").agg(F.sum("n").alias("n"))
    return CharModel({r.g: r.n for r in table.collect()})


def held_out_fold() -> F.Column:
    """True for rows of the held-out fold: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Toxicity:
    """A restorer and the weights of signs."""

    restorer: Restorer
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.memory: dict[str, tuple[str, ...]] = {}
        #: Whether words with these first four letters may carry a sign.
        self.heads: dict[str, bool] = {}
        self.four = {s.removesuffix("-")[:4] for s in self.weights}
        #: The signs as a tree: (next letters, whether a sign ends here, letter).
        self.tree: tuple[dict, list, str] = ({}, [False], "")
        for s in self.weights:
            node = self.tree
            for c in s.removesuffix("-"):
                node = node[0].setdefault(c, ({}, [False], c))
            node[1][0] = True

    def could(self, token: str) -> bool:
        """Whether some reading of a token begins with a sign: every move of Restorer.read() is allowed, at no cost."""
        nodes = {0: self.tree}
        for sign in token:
            free = not sign.isalpha()
            letters = LOOKALIKES.get(sign, "") if free else sign + LOOKALIKES.get(sign, "")
            grown = dict(nodes) if free else {}
            for node in nodes.values():
                for c in letters:
                    then = node[0].get(c)
                    if then is not None:
                        if then[1][0]:
                            return True
                        grown[id(then)] = then
                    if c == node[2]:
                        grown[id(node)] = node
            if not grown:
                return False
            nodes = grown
        return False

    def open_head(self, head: str) -> bool:
        """Whether a word of letters with this beginning may carry a sign."""
        if len(self.heads) > MEMORY:
            self.heads.clear()
        got = self.heads[head] = head in self.four or any(a == b for a, b in pairwise(head)) or any(c in FOREIGN for c in head)
        return got

    def candidates(self, low: str) -> list[str]:
        """The tokens of a lower-case text that may carry a sign; the others carry none under any reading."""
        out = []
        heads = self.heads
        for token in set(low.split()):
            core = token if token.isalpha() else token.strip(OUTER)
            if core.isalpha():
                head = core[:4]
                known = heads.get(head)
                if not (self.open_head(head) if known is None else known):
                    continue
            if token in self.memory or self.could(core):
                out.append(token)
        return out

    def met(self, token: str) -> tuple[str, ...]:
        """The weighed signs of a token."""
        got = self.memory.get(token)
        if got is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            got = tuple(s for s in signs_of(self.restorer.restore(token)) if s in self.weights)
            if len(token) <= 100:
                self.memory[token] = got
        return got

    def score(self, text: str) -> float:
        low = text.lower()
        met = {s for token in self.candidates(low) for s in self.met(token)}
        met.update(s for w in self.restorer.spread(low) for s in signs_of(w) if s in self.weights)
        total = self.bias + sum(self.weights[s] for s in sorted(met))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def _presence(docs: DataFrame, restorer: Restorer) -> DataFrame:
    """Rows (doc_id, toxic, words) of the signs in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                words = [sorted({s for w in restorer.words(t) for s in signs_of(w)}) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    return docs.mapInArrow(common.each(run), "doc_id long, toxic int, words array<string>")


def fit_weights(features: np.ndarray, labels: np.ndarray, prior: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, held near prior weights, since signs that come together share their credit."""
    x = np.column_stack([np.ones(len(features)), features])
    prior = np.append(-2.0, prior)
    w = np.append(-2.0, np.zeros(features.shape[1]))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - labels * z) + 0.5 * np.sum(penalty * (w - prior) ** 2))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - labels) + penalty * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step, scale = np.linalg.solve(curve, gradient), 1.0
        while scale > 1e-4 and (then := loss(w - scale * step)) > now:
            scale /= 2
        if scale <= 1e-4 or now - then < 1e-9 * max(1.0, now):
            break
        w, now = w - scale * step, then
    return w[1:], float(w[0])


def distinct_signs(signs: list[tuple]) -> list[tuple]:
    """signs without beginnings that occur in as many texts as a longer one of the same family."""
    kept: dict[tuple, list[tuple]] = {}
    for s in sorted(signs, key=lambda s: (s[0].endswith("-"), -len(s[0]), s[0])):
        same = kept.setdefault((s[1], s[2]), [])
        if not (s[0].endswith("-") and any(k[0].startswith(s[0][:-1]) for k in same)):
            same.append(s)
    return sorted(s for same in kept.values() for s in same)


def carriers(words: DataFrame, signs: list[str]) -> dict[str, int]:
    """Every counted word that carries one of the signs, however rare."""
    beginnings = [F.substring("word", 1, k).isin([s[:-1] for s in signs if s.endswith("-") and len(s) == k + 1]) & (F.length("word") > k) for k in PREFIXES]
    held = F.col("word").isin([s for s in signs if not s.endswith("-")])
    for beginning in beginnings:
        held = held | beginning
    return {r.word: r.n for r in words.filter(held & (F.length("word") > 2)).collect()}


def labelled_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Restorer, DataFrame, DataFrame]:
    """A restorer, rows (doc_id, toxic, words) of the labelled texts that the score may learn from, and the word counts."""
    spark = docs.sparkSession
    words = common.stored(word_counts(docs), "word-counts")
    total = words.agg(F.sum("n")).first()[0] or 0
    lexicon = {r.word: r.n for r in words.filter((F.length("word") > 2) & (F.col("n") * FREQUENT >= total)).collect()}  # FREQUENT rows at most
    restorer = Restorer(char_model(words), lexicon)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.filter(~held_out_fold()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # sample rows at most
    chosen = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    return restorer, common.stored(_presence(rows, restorer), "labelled-words"), words


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """Learn from the labelled rows outside the held-out fold."""
    restorer, seen, words = labelled_words(docs, labels, sample)
    lexicon = restorer.lexicon
    sizes = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Toxicity(restorer, {}, 40.0 if share else -40.0)
    per = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEWEST)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1.0))
    best = per.withColumn("odds", odds).withColumn("gain", F.round(F.abs("odds") * F.sqrt("t"), 9)).filter((F.col("odds") > LEAST_ODDS) & (F.col("t") >= FEWEST)).orderBy(F.desc("gain"), "word").limit(SIGNS)
    best = distinct_signs([(r.word, r.t, r.n, r.odds) for r in best.collect()])
    chosen_words = [b[0] for b in best]
    place = {w: i for i, w in enumerate(chosen_words)}
    held = seen.select("doc_id", "toxic", F.array_intersect("words", F.array(*map(F.lit, chosen_words))).alias("words")).orderBy("doc_id", "toxic").collect()
    x, y = np.zeros((len(held), len(place))), np.zeros(len(held))
    for i, r in enumerate(held):
        y[i] = r.toxic
        for w in r.words:
            x[i, place[w]] = 1
    weights, bias = fit_weights(x, y, PRIOR * np.array([b[3] for b in best]))
    learned = {w: float(v) for w, v in zip(chosen_words, weights, strict=True)}
    strong = [w for w, v in learned.items() if v > 0.5]
    restorer.lexicon = lexicon | {w: lexicon.get(w, 1) for w in strong if not w.endswith("-")} | carriers(words, strong)
    return Toxicity(Restorer(restorer.model, restorer.lexicon), learned, bias)


def scored(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", held_out_fold().alias("held_out"), common.text_of().alias("text")).mapInArrow(common.each(run), RESULT)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the labels and score every text."""
    common.session_setup(docs.sparkSession)
    return scored(docs, train(docs, labels, sample))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that are predicted toxic."""
    common.session_setup(docs.sparkSession)
    model = train(docs, labels)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t or "") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(common.each(run), schema)
