"""Language identification by a linear-chain conditional random field over words.

Each word's features are its character 1- to 3-grams (those at the ends are affixes), its prefix and
suffix of four letters, and an entry of the lexicon of words that are frequent in the sample. Together
with learned transitions they give every word of a text its label probabilities by forward-backward,
so words of code-switched text are labelled in context. A text's language has the largest mean
probability over its words, and that mean is the score.

The field is fitted on a bounded sample of labelled rows (``SAMPLE`` texts, equally many of each language, at most
``SAMPLE_BYTES`` bytes of each), spliced into code-switched sequences so that transitions are learned. Every text is labelled
whole: words are scored once each, and forward-backward runs over blocks of words, first with the
blocks' transfer matrices, then inside all blocks at once.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwire.llm.common import slices, text_of
from cellwire.llm.repeats import gram_hashes, mixed
from cellwire.operators.session import materialize

SAMPLE = 1500
SAMPLE_BYTES = 20_000
LEAST_OF_EACH = 8
FEATURES = 1 << 16
BLOCK = 32
CACHE_WORDS = 400_000
UNKNOWN = "und"

_KNOWN: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _KNOWN:
        _KNOWN["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _KNOWN["letters"]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature) pairs of lower-case words, and whether each has a letter. Other characters are left out."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    keep = _letters()[codes]
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    size = np.bincount(owner, minlength=len(words))
    # Word ends become symbols of their own.
    ends = np.cumsum(size + 2)
    starts = ends - size - 2
    flat = np.full(int(ends[-1]) if len(ends) else 0, 2, np.uint64)
    flat[ends - 1] = 3
    at = np.arange(len(codes)) + 2 * owner + 1
    flat[at] = codes
    place = np.repeat(np.arange(len(words)), size + 2)
    flat = mixed(flat)
    who, what = [], []
    for n in (1, 2, 3):
        grams = gram_hashes(flat, n)
        inside = place[: len(grams)] == place[n - 1:]
        who.append(place[: len(grams)][inside])
        what.append(mixed(grams[inside] + np.uint64(n)) % np.uint64(FEATURES))
    long = np.flatnonzero(size >= 4)
    if len(long):
        grams = gram_hashes(flat, 5)
        for kind, pos in ((11, starts[long]), (12, ends[long] - 5)):
            who.append(long)
            what.append(mixed(grams[pos] + np.uint64(kind)) % np.uint64(FEATURES))
    known = [(k, lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    if known:
        who.append(np.array([k for k, _ in known]))
        what.append(np.array([FEATURES + i for _, i in known], np.uint64))
    return np.concatenate(who), np.concatenate(what).astype(np.int64), size > 0


def posteriors(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; texts of ``lengths`` words (none empty) follow each other.

    ``emission``: positive word scores; ``moves``: positive transition scores; ``start``: of first words.
    """
    n, labels = emission.shape
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[text] + number * BLOCK
    size = np.minimum(BLOCK, lengths[text] - number * BLOCK)
    # Positions of each block's words; those beyond its size change nothing.
    grid = np.full((BLOCK, len(text), labels), 1.0)
    inside = np.arange(BLOCK)[:, None] < size[None, :]
    where = (at[None, :] + np.arange(BLOCK)[:, None])[inside]
    grid[inside] = emission[where]

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    # The transfer matrix of each block: entering with a label before its first word.
    transfer = np.broadcast_to(np.eye(labels), (len(text), labels, labels)).copy()
    for t in range(BLOCK):
        on = inside[t]
        if not on.any():
            break
        step = transfer[on].reshape(-1, labels) @ moves
        step = step.reshape(-1, labels, labels) * grid[t][on][:, None, :]
        transfer[on] = step / step.max(axis=(1, 2), keepdims=True)
    # Across the blocks of each text, all texts at once.
    by_number = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[by_number], np.arange(number.max() + 2))
    before = np.empty((len(text), labels))  # weights of the label before a block, from the left
    after = np.ones((len(text), labels))  # of the last label of a block, from the right
    for k in range(len(cut) - 1):
        some = by_number[cut[k]:cut[k + 1]]
        if k == 0:
            before[some] = 1.0
        else:
            left = before[some - 1]
            if k == 1:
                left = _entered(grid, moves, start, some - 1, inside)
            else:
                left = np.einsum("bi,bij->bj", left, transfer[some - 1])
            before[some] = scaled(left)
    for k in range(len(cut) - 2, 0, -1):
        some = by_number[cut[k]:cut[k + 1]]
        after[some - 1] = scaled(np.einsum("bij,bj->bi", transfer[some], after[some]))
    # Inside all blocks at once.
    forward = np.empty_like(grid)
    state = np.where(number[:, None] == 0, start[None, :], before @ moves)
    state = scaled(state * grid[0])
    forward[0] = state
    for t in range(1, BLOCK):
        state = np.where(inside[t][:, None], scaled(state @ moves * grid[t]), state)
        forward[t] = state
    state = after
    for t in range(BLOCK - 1, -1, -1):
        forward[t] *= state
        state = np.where(inside[t][:, None], scaled((grid[t] * state) @ moves.T), state)
    out = np.empty_like(emission)
    out[where] = scaled(forward[inside])
    return out


def _entered(grid, moves, start, some, inside) -> np.ndarray:
    """Forward weights at the end of first blocks, whose first word has the start scores."""
    state = start[None, :] * grid[0][some]
    for t in range(1, BLOCK):
        step = state @ moves * grid[t][some]
        state = np.where(inside[t][some][:, None], step / step.sum(axis=1, keepdims=True), state)
    return state


class Field:
    """Weights of features, transitions and first words."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels = labels
        self.lexicon = lexicon
        self.weights = np.zeros((FEATURES + len(lexicon), len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))
        self.start = np.zeros(len(labels))

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores of each word's labels, and whether it has a letter."""
        who, what, letters = features(words, self.lexicon)
        n = len(words)
        return np.stack([np.bincount(who, self.weights[what, k], n) for k in range(len(self.labels))], axis=1), letters

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], rounds: int = 3, window: int = 64, batch: int = 64, seed: int = 5) -> Field:
        labels = sorted(set(langs))
        cut = [t.lower().split() for t in texts]
        count = Counter(w for words in cut for w in set(words))
        field = cls(labels, {w: i for i, w in enumerate(sorted(w for w, c in count.items() if c >= 5))})
        if len(labels) < 2:
            return field
        rng = np.random.default_rng(seed)
        index = {label: k for k, label in enumerate(labels)}
        # Splice texts two by two in alternating stretches, so that labels change inside sequences.
        order = rng.permutation(len(cut))
        sequence, gold = [], []
        for a, b in zip(order[::2], order[1::2], strict=False):
            left, right = list(cut[a]), list(cut[b])
            pair, at = [(left, index[langs[a]]), (right, index[langs[b]])], [0, 0]
            turn = 0
            while at[0] < len(left) or at[1] < len(right):
                size = int(rng.integers(8, 60))
                words, label = pair[turn]
                stretch = words[at[turn]:at[turn] + size]
                sequence += stretch
                gold += [label] * len(stretch)
                at[turn] += size
                turn = 1 - turn
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(sequence))}
        words = list(vocabulary)
        who, what, letters = features(words, field.lexicon)
        by_word = np.argsort(who, kind="stable")
        what = what[by_word]
        ends = np.cumsum(np.bincount(who, minlength=len(words)))
        sizes = np.diff(np.r_[0, ends])
        ids = np.array([vocabulary[w] for w in sequence])
        gold = np.array(gold)
        good = letters[ids]
        ids, gold = ids[good], gold[good]
        n = len(ids) // window
        ids, gold = ids[: n * window].reshape(n, window), gold[: n * window].reshape(n, window)
        squares = np.full(field.weights.shape, 1e-2, np.float32)
        move_squares = np.full(field.moves.shape, 1e-2)
        count_labels = len(labels)
        for _ in range(rounds):
            for some in np.array_split(rng.permutation(n), max(1, n // batch)):
                x, y = ids[some], gold[some]
                distinct, where = np.unique(x, return_inverse=True)
                where = where.reshape(x.shape)
                count_of = sizes[distinct]
                rows = np.repeat(np.arange(len(distinct)), count_of)
                columns = what[np.repeat(ends[distinct] - sizes[distinct] - np.cumsum(count_of) + count_of, count_of) + np.arange(count_of.sum())]
                score = np.stack([np.bincount(rows, field.weights[columns, k], len(distinct)) for k in range(count_labels)], axis=1)
                e = np.exp(score - score.max(axis=1, keepdims=True))[where]
                moves, start = np.exp(field.moves), np.exp(field.start)
                alpha = np.empty(e.shape)
                state = start * e[:, 0]
                alpha[:, 0] = state = state / state.sum(1, keepdims=True)
                for t in range(1, window):
                    state = state @ moves * e[:, t]
                    alpha[:, t] = state = state / state.sum(1, keepdims=True)
                beta = np.ones((len(x), count_labels))
                expected = np.zeros_like(moves)
                error = np.empty(e.shape)
                for t in range(window - 1, -1, -1):
                    post = alpha[:, t] * beta
                    error[:, t] = post / post.sum(1, keepdims=True)
                    if t:
                        right = e[:, t] * beta
                        joint = alpha[:, t - 1][:, :, None] * moves[None] * right[:, None, :]
                        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
                        beta = right @ moves.T
                        beta /= beta.sum(1, keepdims=True)
                np.add.at(expected, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
                error[np.arange(len(x))[:, None], np.arange(window)[None, :], y] -= 1
                of_word = np.stack([np.bincount(where.ravel(), error[:, :, k].ravel(), len(distinct)) for k in range(count_labels)], axis=1)
                touched, column = np.unique(columns, return_inverse=True)
                gradient = np.stack([np.bincount(column, of_word[rows, k], len(touched)) for k in range(count_labels)], axis=1) / len(x)
                squares[touched] += gradient * gradient
                field.weights[touched] -= 0.2 * gradient / np.sqrt(squares[touched])
                step = expected / len(x)
                move_squares += step * step
                field.moves -= 0.2 * step / np.sqrt(move_squares)
        return field


class Labeller:
    """A field with the scores of the words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.moves, self.start = np.exp(field.moves), np.exp(field.start)
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(field.labels)))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words with letters, and their number in each text."""
        cut = [t.lower().split() for t in texts]
        new = list(set().union(*cut).difference(self.index))
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index, self.table = {}, self.table[:0]
            new = list(set().union(*cut))
        if new:
            score, letters = self.field.scores(new)
            spots = np.where(letters, len(self.table) + np.cumsum(letters) - 1, -1).tolist()
            self.index.update(zip(new, spots, strict=True))
            score = score[letters]
            self.table = np.concatenate([self.table, np.exp(score - score.max(axis=1, keepdims=True)) + 1e-30])
        known = self.index.__getitem__
        spots = [np.fromiter(map(known, words), np.int64, len(words)) for words in cut]
        spots = [s[s >= 0] for s in spots]
        lengths = np.array([len(s) for s in spots], np.int64)
        some = lengths > 0
        if not some.any():
            return np.zeros((0, len(self.field.labels))), lengths
        emission = self.table[np.concatenate(spots)]
        return posteriors(emission, lengths[some], self.moves, self.start), lengths

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; texts without a letter are unknown with score 0."""
        out: list[tuple[str, float]] = []
        for start, stop in slices(texts):
            each, lengths = self.words(texts[start:stop])
            ends = np.cumsum(lengths)
            total = np.vstack([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
            for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
                if not n:
                    out.append((UNKNOWN, 0.0))
                    continue
                mean = (total[end] - total[end - n]) / n
                best = int(mean.argmax())
                out.append((self.field.labels[best], float(min(1.0, max(0.0, mean[best])))))
        return out


def learnt(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: text and language given, crc32 of the id not 2 modulo 4."""
    return docs.where("text IS NOT NULL AND lang IS NOT NULL AND coalesce(crc32(CAST(doc_id AS STRING)) % 4, 2) <> 2")


def sample_of(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, least: int = LEAST_OF_EACH) -> DataFrame:
    """(doc_id, text, lang) of the labelled rows that a field is fitted on, chosen by a hash of the id.

    Every language gives equally many documents, ``sample`` in all, or ``least`` each where that is more; one
    with fewer gives all it has. A text above ``sample_bytes`` bytes gives a stretch of a quarter as many characters.
    """
    usable = learnt(docs).select("doc_id", "text", "lang")
    # Ids first: a document of several rows counts once, and no text is sorted.
    ids = usable.select("lang", "doc_id").distinct()
    sizes = materialize(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_all")))
    each = max(least, sample // max(1, sizes.count()))
    # Only hashes below a bound meet in one task: some four times as many as are wanted, however many there are.
    space = 1 << 40
    bound = F.lit(float(space)) * (4 * each + 64) / F.col("_all")
    placed = ids.join(sizes, "lang").withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(space))).where(F.col("_h") < bound)
    drawn = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = placed.withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= each).select("lang", "doc_id")
    rows = usable.join(F.broadcast(ids), ["lang", "doc_id"]).dropDuplicates(["lang", "doc_id"])
    length = sample_bytes // 4
    start = f"1 + pmod(xxhash64(doc_id, 5), greatest(char_length(text) - {length}, 1))"
    cut = F.expr(f"CASE WHEN octet_length(text) > {sample_bytes} THEN substring(text, CAST({start} AS INT), {length}) ELSE text END")
    return rows.select("doc_id", cut.alias("text"), "lang")


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fit on ``sample_of(docs)``; its size is bounded by the parameters, and nothing else reaches the driver.

    Without labelled rows the field has the single label ``und``.
    """
    rows = sorted(sample_of(docs, sample, sample_bytes).collect(), key=lambda r: (r["doc_id"], r["lang"]))
    if not rows:
        return Field([UNKNOWN], {})
    return Field.fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every text.

    held_out: crc32 of doc_id as text is 2 modulo 4 (false for a null id). A text that is null or has
    no letter is ``und`` with score 0.0; ties go to the first label in order. Repeated rows get equal
    results; an empty table stays empty; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    held: dict = {}

    def run(batches):
        if "labeller" not in held:
            held["labeller"] = Labeller(shared.value)
        for batch in batches:
            found = held["labeller"].label(text_of(batch["text"]))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                "lang_pred": [x[0] for x in found], "score": [x[1] for x in found],
            })

    held_out = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 4 = 2"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def language(field: Field, spark):
    """A column function: the label and score of a text as struct<lang_pred, score>, by the rules of ``identify``."""
    shared = spark.sparkContext.broadcast(field)
    held: dict = {}

    @F.pandas_udf("lang_pred string, score double")
    def label(text: pd.Series) -> pd.DataFrame:
        if "labeller" not in held:
            held["labeller"] = Labeller(shared.value)
        return pd.DataFrame(held["labeller"].label(text_of(text)), columns=["lang_pred", "score"])

    return label
