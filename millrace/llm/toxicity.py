"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Lexicons. A bounded, hash-ordered sample of labelled training rows gives word stems (word beginnings of
   3 to 8 letters, and whole words) whose presence goes with the label. They are the lexicon voters: +1 on
   presence, silent otherwise. Pattern voters look at the shape of a text only.
2. Label model. Votes are noisy readings of a hidden class. EM fits the class share, each voter's P(vote | class)
   and a forest of pairs of voters that depend on each other beyond the class, with a table for each pair, on
   labelled and unlabelled training documents. The given labels start it, which says which class is which, and are one more
   noisy reading whose accuracy is estimated; rows without one lack it, and weigh less where they would draw the class
   away from the labels: with lexicons of several languages, silence on the largest one isn't what makes a text clean.
3. Classifier. Logistic regression on stem presence is trained on the posteriors, which are those of the votes
   alone: no given label reaches it. Only this classifier scores documents.

Labels enter through training rows alone (crc32 of the id modulo 5 not 0). Language, source and id are
inputs of nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, hash_first
from millrace.runtime import Written, small_batches

#: Bounds of the fit: training rows of either label, stems, lexicon voters.
SAMPLE_TOXIC, SAMPLE_CLEAN, MAX_STEMS, MAX_VOTERS = 2000, 4000, 600, 96
STEM_LETTERS = (3, 4, 5, 6, 7, 8)
#: Stems that a task counts before it passes them on.
COUNTED = 100_000
#: A stem needs so many toxic sample rows, and such a share of toxic rows among all that have it.
MIN_TOXIC_ROWS, MIN_PRECISION = 3, 0.75
#: Rows without a label that the label model sees too, and among how many rows (times that) they are sought.
SAMPLE_UNKNOWN, SOUGHT = 4000, 4
#: What a row without a label may weigh in the label model, and how many times the least loss of the labels is put up with for it.
UNKNOWN_WEIGHTS, LOSS_KEPT = (1.0, 0.1, 0.01), 1.2
#: First posteriors of labelled rows, and the classifier's penalty.
FIRST, PENALTY = (0.05, 0.9), 0.3
#: Clean rows joined into long ones for the classifier: how many at a time, how often each, and below which posterior a row is surely clean.
JOINED_SIZES, JOINED_EACH, SURELY_CLEAN = (2, 4, 8, 16, 32, 64, 128, 256), 64, 0.02
#: Distinct words beyond which a stem counts less.
LONG = 400
#: Rows added to a voter's counts, rows of its own distribution added to each row of an edge's table, and what an edge must gain (times the log of the rows).
SMOOTH, LEAN, EDGE_COST = np.array([0.05, 0.1, 0.05]), 5.0, 4.0
_SPLIT = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_LETTER, _CAPITAL = re.compile(r"[^\W\d_]"), re.compile(r"[A-Z\u00C0-\u00D6\u00D8-\u00DE]")
_LOUD, _SECOND = re.compile(r"[!?]{2,}"), re.compile(r"(?i)\b(you|your|du|dich|tu|toi|vous)\b")


def words_of(text: str) -> set[bytes]:
    """Distinct lower-cased words, as UTF-8; everything in ASCII but letters parts them."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split())


def stems_of(text: str) -> set[bytes]:
    """Words (marked by a blank) and their beginnings. Beginnings are cut in letters, not bytes."""
    out = set()
    for word in words_of(text):
        out.add(word + b" ")
        letters = word.decode("utf-8", "surrogatepass")
        out.update(letters[:k].encode("utf-8", "surrogatepass") for k in STEM_LETTERS if len(letters) >= k)
    return out


def pattern_votes(text: str) -> list[int]:
    """Votes of the shape of a text: shouting marks, the second person, capitals. 0: no opinion."""
    letters, capitals = len(_LETTER.findall(text)), len(_CAPITAL.findall(text))
    return [
        1 if len(_LOUD.findall(text)) >= 3 else 0,
        1 if len(_SECOND.findall(text)) >= 5 else 0,
        1 if 2 * capitals > letters > 20 else 0,
        -1 if letters < 8 else 0,
    ]


@dataclass
class LabelModel:
    """P(votes, label, class) as a forest: P(class), P(label | class), P(vote | class, vote of the voter leant on).

    Pairs of voters that depend on each other beyond the class are edges of the forest, each with its table for
    either class: the model's correlations. A near copy of a voter adds nothing to the posterior, as its table says
    so. `accuracy` is each voter's own P(vote | class), its edge summed out. Voters are taken to be better than
    chance: no table lets a vote speak for the class that it is against. Given labels are a noisy reading like the
    votes, of estimated accuracy; rows may lack them.
    """

    share: float = 0.1
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # -1: leans on none
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3, 3)))  # [voter, class, parent's vote, vote]; votes -1, 0, 1 at 0, 1, 2
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))
    labelled: np.ndarray = field(default_factory=lambda: np.full((2, 2), 0.5))  # [class, label]
    likelihood: list[float] = field(default_factory=list)  # mean logarithm a row after each round

    def _class_logs(self, votes: np.ndarray, labels: np.ndarray | None) -> np.ndarray:
        """[row, class]: log P(votes, label, class)."""
        at = votes + 1
        leans = np.where(self.parent >= 0, at[:, self.parent], 0)
        logs = np.log(self.table)
        voter = np.arange(votes.shape[1])
        out = np.stack([logs[voter, c, leans, at].sum(1) for c in (0, 1)], 1) + np.log([1 - self.share, self.share])
        if labels is not None:
            out += np.where(labels[:, None] >= 0, np.log(self.labelled).T[np.maximum(labels, 0)], 0)
        return out

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """votes: [row, voter] in -1, 0, 1; labels: 0, 1, or -1 where there is none. P(class = 1 | votes, labels)."""
        logs = self._class_logs(votes, labels)
        return 1 / (1 + np.exp(-np.clip(logs[:, 1] - logs[:, 0], -40, 40)))

    @staticmethod
    def fit(votes: np.ndarray, start: np.ndarray, labels: np.ndarray | None = None, weight: np.ndarray | None = None, rounds: int = 60, forests: int = 3) -> LabelModel:
        """Expectation maximisation from `start`, a first posterior for each row that says which class is which.

        The forest is the heaviest one over pairs whose dependence within the classes is worth its parameters. It is
        chosen from the labelled rows' first posteriors (all rows' where there are no labels), as EM without it would
        take two copies of one voter for the class; then anew between runs of EM, `forests` times in all.
        """
        n = len(votes)
        weight = np.ones(n) if weight is None else weight * (n / weight.sum())
        told = np.ones(n, bool) if labels is None or not (labels >= 0).any() else labels >= 0
        own, q = LabelModel(parent=_forest(votes[told], start[told], weight[told])), start
        for k in range(forests):
            own.likelihood.clear()
            for _ in range(rounds):
                own._maximise(votes, q, labels, weight)
                before, logs = q, own._class_logs(votes, labels)
                q = own.posterior(votes, labels)
                own.likelihood.append(float((weight * np.logaddexp(logs[:, 0], logs[:, 1])).mean()))
                if np.abs(q - before).max(initial=0) < 1e-4:
                    break
            if k == forests - 1 or ((forest := _forest(votes, q, weight)) == own.parent).all():
                break
            own.parent = forest
        return own

    def loss(self, votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
        """Mean -log P(label | votes) of the rows that have a label."""
        told = labels >= 0
        q = self.posterior(votes[told])
        return float(-(weight[told] * np.log((np.stack([1 - q, q], 1) * self.labelled[:, labels[told]].T).sum(1))).sum() / weight[told].sum())

    @staticmethod
    def fit_told(votes: np.ndarray, start: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> LabelModel:
        """As `fit`, with rows without a label weighing as much as they may.

        Where the class falls into kinds that share no voters, the likeliest model of many rows without a label is one kind
        against all the rest, whatever the labels say. So of UNKNOWN_WEIGHTS the largest is taken at which the votes
        tell the labels about as well as at the best one.
        """
        told = labels >= 0
        models = [LabelModel.fit(votes, start, labels, np.where(told, weight, weight * k)) for k in (UNKNOWN_WEIGHTS if not told.all() else UNKNOWN_WEIGHTS[:1])]
        losses = [m.loss(votes, labels, weight) for m in models]
        return next(m for m, x in zip(models, losses, strict=True) if x <= LOSS_KEPT * min(losses))

    def _maximise(self, votes: np.ndarray, q: np.ndarray, labels: np.ndarray | None, weight: np.ndarray) -> None:
        at, mass = votes + 1, np.stack([weight * (1 - q), weight * q], 1)
        leans = np.where(self.parent >= 0, at[:, self.parent], 0)
        both = np.stack([[np.bincount(leans[:, j] * 3 + at[:, j], mass[:, c], 9).reshape(3, 3) for c in (0, 1)] for j in range(votes.shape[1])]).reshape(-1, 2, 3, 3)
        single = both.sum(2) + SMOOTH
        self.accuracy = _better_than_chance(single)
        edge = _better_than_chance(both + LEAN * self.accuracy[:, :, None, :])
        self.table = np.where((self.parent >= 0)[:, None, None, None], edge, self.accuracy[:, :, None, :])
        if labels is not None and (labels >= 0).any():
            read = np.stack([np.bincount(labels[labels >= 0], mass[labels >= 0, c], 2) for c in (0, 1)]) + 1.0
            self.labelled = read / read.sum(1, keepdims=True)
        self.share = float(np.clip((weight * q).sum() / len(q), 0.001, 0.999))


def _better_than_chance(counts: np.ndarray) -> np.ndarray:
    """Shares of the votes (last axis) for either class (axis 1); where a vote speaks for the class it is against, the classes share theirs."""
    out = counts / counts.sum(-1, keepdims=True)
    pooled = counts.sum(1, keepdims=True)
    pooled = pooled / pooled.sum(-1, keepdims=True)
    seen = counts.sum(1) > 1  # a vote that never occurs has the added counts alone, and speaks for nothing
    wrong = (out[:, 1, ..., 2] < out[:, 0, ..., 2]) & seen[..., 2] | (out[:, 0, ..., 0] < out[:, 1, ..., 0]) & seen[..., 0]
    return np.where(np.expand_dims(wrong, (1, -1)), pooled, out)


def _forest(votes: np.ndarray, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each voter the one it leans on: the heaviest forest by conditional mutual information given the class."""
    rows, m = votes.shape
    one = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(np.float32).reshape(rows, 3 * m)
    pairs = np.stack([((one * (weight * p)[:, None].astype(np.float32)).T @ one).reshape(m, 3, m, 3) for p in (1 - q, q)]).astype(float)  # [class, voter, vote, voter, vote]
    n, m = pairs[:, 0, :, 0, :].sum(), pairs.shape[1]
    p = pairs / n
    single = np.einsum("cjajb->cja", p)
    mass = single.sum(2)[:, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = single[:, :, :, None, None] * single[:, None, None, :, :] / mass[:, :, None, None, None]
        gain = np.where(p > 0, p * np.log(p / apart), 0).sum((0, 2, 4))
    worth = np.argwhere(np.triu(gain * n > EDGE_COST * np.log(max(n, 2)), 1))
    parent, root = np.full(m, -1), np.arange(m)
    near: list[list[int]] = [[] for _ in range(m)]
    for j, k in worth[np.argsort([-gain[j, k] for j, k in worth], kind="stable")] if len(worth) else []:
        if root[j] != root[k]:
            root[root == root[k]] = root[j]
            near[j].append(k)
            near[k].append(j)
    seen: set[int] = set()
    for top in range(m):
        stack = [] if top in seen else [(top, -1)]
        while stack:
            j, above = stack.pop()
            seen.add(j)
            parent[j] = above
            stack += [(k, j) for k in near[j] if k != above]
    return parent


def logistic(x: np.ndarray, target: np.ndarray, penalty: float, weight: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps on targets in 0 to 1; the last weight is the offset, without penalty."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (target - p)) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def length_scale(n):
    """What a stem counts in a text of n distinct words: less in long texts, where stems also come by chance."""
    return 1 / np.sqrt(np.maximum(1.0, np.asarray(n) / LONG))


@dataclass(frozen=True)
class Model:
    stems: dict[bytes, float]
    offset: float

    def score(self, text: str | None) -> float:
        """Probability of the classifier: each stem that the text has counts once, as in training."""
        get, words = self.stems.get, words_of(text or "")
        found = {key for word in words if (key := word + b" ") in self.stems}
        for word in words:
            plain = word.isascii()
            letters = word if plain else word.decode("utf-8", "surrogatepass")
            for k in STEM_LETTERS:
                if len(letters) < k:
                    break
                if (stem := letters[:k] if plain else letters[:k].encode("utf-8", "surrogatepass")) in self.stems:
                    found.add(stem)
        z = self.offset + sum(map(get, sorted(found))) * length_scale(len(words))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def joined_texts(x: np.ndarray, q: np.ndarray, size: np.ndarray, each: int = JOINED_EACH, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Scaled presence rows and posteriors of long texts: rows that are surely clean, joined by twos, fours and so on.

    What comes together by chance in a long clean text is no evidence, and only such rows show it. A joined text is as
    likely to be toxic as its likeliest part.
    """
    clean = np.flatnonzero(q < SURELY_CLEAN)
    if not len(clean):
        return x[:0] * 1.0, q[:0]
    rng = np.random.default_rng(seed)
    rows, target = [], []
    for many in JOINED_SIZES:
        for _ in range(each):
            own = rng.choice(clean, min(many, len(clean)), replace=False)
            rows.append(x[own].max(0) * length_scale(size[own].sum()))  # words that parts share count twice: as if the text were longer
            target.append(q[own].max())
    return np.array(rows), np.array(target)


def bounded_logistic(x: np.ndarray, target: np.ndarray, penalty: float, weight: np.ndarray) -> np.ndarray:
    """As `logistic`, with no weight below zero but the offset: those that would be are held at zero and the rest is fitted anew."""
    free = np.ones(x.shape[1], bool)
    while True:
        w = logistic(x[:, free], target, penalty, weight)
        below = w[:-1] < 0
        if not below.any():
            break
        free[np.flatnonzero(free)[below]] = False
    out = np.zeros(x.shape[1] + 1)
    out[:-1][free], out[-1] = w[:-1], w[-1]
    return out


def _training_rows(labels: DataFrame, id_col: str, toxic_col: str = "toxic") -> DataFrame:
    rows = labels.select(F.col(id_col).alias("_id"), F.col(toxic_col).cast("int").alias("toxic"))
    return rows.where((fold(F.col("_id"), 5) != 0) & F.col("_id").isNotNull() & F.col("toxic").isin(0, 1))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str = "toxic", n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, n_unknown: int = SAMPLE_UNKNOWN) -> tuple[DataFrame, dict[int, int]]:
    """(_id, toxic, text) of at most n_toxic + n_clean labelled training rows and n_unknown others (toxic -1), by hash order of the id.

    Also returns how many labelled training rows there are of either kind. Rows with a null id or label, and of the
    held-out fold, don't take part; a null text counts as empty. The rows without a label are those among the first
    SOUGHT * n_unknown training documents; there may be fewer. An id with both labels is drawn for each; of the
    documents that repeat a drawn id the least text counts.
    """
    train = _training_rows(labels, id_col, toxic_col)
    there = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    own = docs.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull() & (fold(F.col("_id"), 5) != 0))
    first = Written(hash_first(own, "_id", SOUGHT * n_unknown, own.count()), "toxic-first")
    told = labels.select(F.col(id_col).alias("_id")).join(F.broadcast(first.df), "_id", "left_semi").distinct()  # at most SOUGHT * n_unknown ids
    unknown = first.df.join(F.broadcast(told), "_id", "left_anti").orderBy(F.xxhash64("_id"), "_id").limit(n_unknown).select("_id", F.lit(-1).alias("toxic"))
    toxic, clean = (hash_first(train.where(F.col("toxic") == k), "_id", n, there.get(k, 0)) for k, n in ((1, n_toxic), (0, n_clean)))
    picked = Written(toxic.union(clean).union(unknown), "toxic-sample")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = texts.join(F.broadcast(picked.df), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text"))  # ids of the bounded sample
    out = Written(drawn, "toxic-texts").df
    first.drop()
    picked.drop()
    return out, there


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of stems, given out whenever COUNTED of them are held."""
    held: dict[bytes, list[int]] = {}

    def out() -> pd.DataFrame:
        part = pd.DataFrame({"stem": list(held), "toxic": [c[1] for c in held.values()], "clean": [c[0] for c in held.values()]})
        held.clear()
        return part

    for batch in batches:
        for label, text in zip(batch["toxic"], batch["text"], strict=True):
            for stem in stems_of(text or ""):
                held.setdefault(stem, [0, 0])[label] += 1
            if len(held) > COUNTED:
                yield out()
    yield out()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> Model:
    """Fit on the bounded sample; the driver gets stem counts (MAX_STEMS) and a presence row for each sample row."""
    small_batches(docs.sparkSession)
    sample, there = training_sample(docs, labels, id_col, text_col, **bounds)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, 40.0 if n1 else -40.0)
    told = sample.where("toxic >= 0").select("toxic", "text")
    counts = told.mapInPandas(_counts, "stem binary, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    base = there[1] / (there[1] + there[0])
    t, c = F.col("t") * (there[1] / n1), F.col("c") * (there[0] / n0)  # in all training rows
    found = counts.where((F.col("t") >= MIN_TOXIC_ROWS) & (t >= MIN_PRECISION * (t + c)))
    apart = t * F.log(t / (t + c) / base) + F.when(c > 0, c * F.log(c / (t + c) / (1 - base))).otherwise(0.0)  # how far from chance
    rows = found.orderBy(F.desc(F.round(apart, 6)), F.length("stem"), "stem").limit(MAX_STEMS).collect()
    stems = _distinct_stems([bytes(r["stem"]) for r in rows])
    place = {s: k for k, s in enumerate(stems)}

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "place": batch["place"],
                "toxic": batch["toxic"],
                "hits": [sorted(place[s] for s in stems_of(t) if s in place) for t in batch["text"]],
                "shape": [pattern_votes(t) for t in batch["text"]],
                "size": [len(words_of(t)) for t in batch["text"]],
            })

    placed = sample.select(F.xxhash64("_id", "toxic", "text").alias("place"), "toxic", "text")
    got = sorted(placed.mapInPandas(seen, "place long, toxic int, hits array<int>, shape array<int>, size long").collect())
    label = np.array([r["toxic"] for r in got])
    x = np.zeros((len(got), len(stems)))
    for k, r in enumerate(got):
        x[k, r["hits"]] = 1
    size = np.array([r["size"] for r in got])
    votes = np.c_[x[:, _voters(x)].astype(int), np.array([r["shape"] for r in got])]
    weight = np.where(label < 0, 1.0, np.where(label > 0, there[1] / n1, there[0] / n0) * (n1 + n0) / (there[1] + there[0]))  # labelled rows in their shares
    start = np.where(label < 0, base, np.where(label > 0, FIRST[1], FIRST[0]))
    q = LabelModel.fit_told(votes, start, label, weight).posterior(votes)
    long_x, long_q = joined_texts(x, q, size)
    w = bounded_logistic(np.r_[x * length_scale(size)[:, None], long_x], np.r_[q, long_q], PENALTY, np.r_[weight, np.ones(len(long_q))])  # a stem never speaks for a text
    return Model({s: float(v) for s, v in zip(stems, w, strict=False) if v > 1e-6}, float(w[-1]))


def _distinct_stems(stems: list[bytes]) -> list[bytes]:
    """Without those that only lengthen a stem that comes before them."""
    out: list[bytes] = []
    taken: set[bytes] = set()
    for stem in stems:
        if not any(stem[:k] in taken for k in range(1, len(stem))):
            taken.add(stem)
            out.append(stem)
    return out


def _voters(x: np.ndarray) -> list[int]:
    """Stems taken as voters: in order of strength, but for those that only repeat one already taken."""
    out: list[int] = []
    for k in range(x.shape[1]):
        if len(out) == MAX_VOTERS:
            break
        if all((x[:, k] * x[:, j]).sum() < 0.95 * max(x[:, k].sum(), x[:, j].sum()) for j in out):
            out.append(k)
    return out


def toxic_score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Null and empty texts score as texts without stems. Without labelled rows of both kinds every score is
    that of the kind there is (0 without any). Labels that are null don't count; a document with several
    labels counts once for each. Repeated rows are scored each for itself; texts of any length are read
    whole.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col), (fold(F.col(id_col), 5) == 0).alias("held_out"), toxic_score(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
