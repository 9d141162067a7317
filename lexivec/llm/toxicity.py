"""Operator 8, toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text, all computed from it alone: densities of four fixed lexicons and of one learned from the training rows,
the share of lexicon words that stand within NEAR words of a word of the second person, and rates of capitals, punctuation,
repeated letters and obfuscated words (as `id1ot`, `i-d-i-o-t`, `iiidiot` read after folding). Trees of depth DEPTH are
boosted on the logistic loss over binned features; a quarter of the training rows, chosen by a hash of the text, is kept
from lexicon and trees to calibrate their margin.

The learned lexicon holds whole words and beginnings of words (so that new inflections count) with the smoothed log-odds of
standing in a toxic document. Its features are the density and number of findings, the same of the clearest ones (STRONG),
how many different words these are, and the weight of the fullest window of WINDOW words. Training rows get these features
from a lexicon that was counted on other rows (FOLDS parts by a hash of the text), so the trees see them as they are on
unseen texts.

The model is fitted on at most SAMPLE labelled rows, those with the least md5 of their id, and has at most LEXICON units.
Units are counted on the executors; units that a hundredth of the toxic rows or more hold, counts and features come to the
driver, never texts. Everything else runs on the executors, text by text.

Defined results: a null text counts as empty; empty texts get the score of a text without any finding; rows with a null
label don't train; without any labelled row every score is 0; equal texts get equal scores; a text is scored whole, however
long, one at a time; an empty table gives no rows; other columns are not read by the model and stay as they are, and the
score's column takes a longer name where the table has its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import tidy
from .shared import free_name, materialize, read_table, small_batches

#: Bound on labelled rows that train.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 60, 3, 0.2, 64, 8, 1.0
#: A split by chance gains about as much as the largest of many chi-square values; only clearer ones are made.
LEAST_GAIN = 3.0
NEAR = 6
#: Parts of the training rows; a row's learned features come from the lexicon of the other parts.
FOLDS = 4
#: Bound on the learned lexicon, the letters that a beginning of a word has, and what a unit must show to be in it.
LEXICON, BEGINNINGS, LEAST_ODDS, LEAST_Z = 4096, range(4, 10), 1.5, 3.0
STRONG, WINDOW = 3.0, 32
#: Bounds of what a worker remembers: weights of words, and counts that are not sent yet.
REMEMBERED, HELD_COUNTS = 100_000, 200_000
SEED = "toxicity"

# Common insults and abuse of four languages, by strength, and words of the second person. Short words that
# are harmless in another of the languages are left out.
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb fool fools clown clowns loser losers pathetic imbecile cretin dimwit halfwit
    simpleton dunce nitwit ignorant ignoramus buffoon brainless idiotic moronic dolt dope twit dullard blockhead
    idiota imbécil estúpido estúpida tonto tonta payaso perdedor patético patética necio
    idiote crétin crétine débile bouffon minable abruti abrutie imbécile stupide pathétique
    dummkopf blödmann trottel depp schwachkopf vollidiot versager erbärmlich dumm blöd""".split()
)
SLURRING = frozenset(
    """scum trash worthless disgusting garbage filth filthy vermin creep creeps freak freaks
    repulsive despicable parasite parasites swine lowlife scumbag scumbags degenerate subhuman maggot
    basura escoria asqueroso asquerosa inútil cerdo cerda despreciable
    ordure ordures déchet dégoûtant dégoûtante répugnant vermine racaille salaud
    abschaum müll wertlos ekelhaft widerlich schwein dreck ungeziefer""".split()
)
PROFANE = frozenset(
    """damn damned crap bastard bastards bitch bitches shit shitty bullshit fuck fucking fucked fucker asshole
    assholes dickhead prick piss pissed slut whore cunt jerk
    mierda puta puto cabrón gilipollas joder pendejo merde putain connard connasse salope foutre
    scheiße scheisse arschloch wichser hurensohn fotze verdammt""".split()
)
THREATS = frozenset("kill killed hang hurt destroy burn choke rot suffer murder beat bleed hate hated despise muere odio matar meurs tuer déteste stirb töten hasse".split())
SECOND = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos usted ustedes ti tú du dich dir dein deine euch ihr".split())
LEXICONS = (INSULTS, SLURRING, PROFANE, THREATS)
_STRONG = INSULTS | SLURRING | PROFANE
_KNOWN = _STRONG | THREATS | SECOND
# Signs that stand for letters.
FOLD = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

FEATURES = ("insults", "slurring", "profane", "threats", "strong_count", "strong_kinds", "near_second", "second", "capital_letters", "capital_words", "exclaiming", "punctuation", "repeats", "obfuscated", "log_words", "learned", "learned_count", "learned_strong", "learned_strong_count", "learned_kinds", "learned_window")

_WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile(r"(?<![^\W_])(?=[\w@$!|*.-]*[^\W\d_])[^\W_](?:[@$!|*.0-9-]*[^\W_]|[@$!|])+")
_REPEAT = re.compile(r"([^\W\d_])\1\1+")
_SUSPECT = re.compile(r"[^\W\d_][0-9@$|*]+[^\W\d_]|[0-9@$|]+[^\W\d_]{2}|(?<![^\W_])[^\W_](?:[.*-][^\W_]){3}")


def _unmasked(text: str) -> int:
    """Words that are strong only after signs are folded to letters and separators or repeats are taken out."""
    found = 0
    if _SUSPECT.search(text):
        for m in _MARKED.finditer(text):
            word = m[0]
            if not word.isalpha() and re.sub(r"[^\W\d_]|[^\w]|_", "", re.sub(r"[*.-]", "", word).translate(FOLD)) == "":
                found += re.sub(r"[*._-]", "", word).translate(FOLD) in _STRONG
    for m in _REPEAT.finditer(text):
        a, b = m.start(), m.end()
        while a and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        word = text[a:b]
        found += word not in _STRONG and (_REPEAT.sub(r"\1", word) in _STRONG or _REPEAT.sub(r"\1\1", word) in _STRONG)
    return found


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word itself (after a space) and its beginnings."""
    return [f" {word}", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def _units_of(text: str) -> set[str]:
    return set().union(*map(units, set(_WORD.findall(text.lower()))))


class _Weights(dict):
    """Weights of words, worked out when they are first asked for."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds, self.stems = odds, {u[: BEGINNINGS[0]] for u in odds if u[0] != " "}

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        own = self.odds.get(f" {word}", 0.0)
        got = self[word] = max(own, *(self.odds.get(u, 0.0) for u in units(word))) if word[: BEGINNINGS[0]] in self.stems else own
        return got


class Lexicon:
    """Log-odds of units; a word has that of its clearest unit, 0 without any."""

    def __init__(self, odds: dict[str, float] | None = None):
        self.odds = odds or {}
        self.weights = _Weights(self.odds)

    def __reduce__(self):
        return Lexicon, (self.odds,)

    def features(self, words: list[str]) -> list[float]:
        n = len(words)
        v = np.fromiter(map(self.weights.__getitem__, words), float, n) if self.odds else np.zeros(n)
        if not v.any():
            return [0.0] * 6
        strong = np.flatnonzero(v >= STRONG)
        along = np.r_[0.0, np.cumsum(v)]
        width = min(WINDOW, n)
        kinds = len({words[i] for i in strong.tolist()})
        return [1000 * along[-1] / n, float(np.count_nonzero(v)), 1000 * len(strong) / n, float(len(strong)), float(kinds), float((along[width:] - along[:-width]).max())]


def log_odds(with_it: dict[str, tuple[int, int]], toxic: int, clean: int) -> Lexicon:
    """The lexicon of units that so many (toxic, clean) documents hold, out of all `toxic` and `clean` ones."""
    found = []
    for unit, (p, n) in with_it.items():
        odds = float(np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1)))
        z = odds / float(np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)))
        if p >= 3 and odds > LEAST_ODDS and z > LEAST_Z:
            found.append((-z, unit, odds))
    return Lexicon({unit: odds for _, unit, odds in sorted(found)[:LEXICON]})


# What stands for a letter (1; `?` is any character beyond ASCII), for a sign in place of one (2), for a separator (4).
_LETTERISH, _SIGN, _BETWEEN = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
for _chars, _kind in (("?abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", _LETTERISH), ("0123456789@$|*", _SIGN), (".*-", _BETWEEN)):
    _KIND[list(_chars.encode())] |= _kind


def _may_mask(raw: np.ndarray) -> bool:
    """Can `_unmasked` find anything? A test on bytes that spares most texts its searches."""
    kind = _KIND[raw]
    letter, sign = kind & _LETTERISH, (kind & _SIGN) >> 1
    if (letter[:-1] & sign[1:]).any() or (sign[:-1] & letter[1:]).any() or ((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (letter[2:] > 0)).any():
        return True
    between = kind & _BETWEEN
    return bool(((between[:-2] > 0) & (between[2:] > 0)).any())


def features(text: str, lexicon: Lexicon = Lexicon()) -> list[float]:
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts, strong, second, kinds = [0, 0, 0, 0], [], [], set()
    if not _KNOWN.isdisjoint(words):
        for i in np.flatnonzero(list(map(_KNOWN.__contains__, words))).tolist():
            w = words[i]
            for k, fixed in enumerate(LEXICONS):
                counts[k] += w in fixed
            if w in _STRONG:
                strong.append(i)
                kinds.add(w)
            if w in SECOND:
                second.append(i)
    near = 0.0
    if strong and second:
        at, s = np.array(second), np.array(strong)
        j = np.searchsorted(at, s)
        gap = np.minimum(np.abs(at[np.minimum(j, len(at) - 1)] - s), np.abs(at[np.maximum(j - 1, 0)] - s))
        near = float((gap <= NEAR).mean())
    size = len(text)
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=128)
    capitals, letters = int(seen[65:91].sum()), int(seen[65:91].sum() + seen[97:123].sum())
    signs = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    big = (raw >= 65) & (raw <= 90)
    shouted = int(np.count_nonzero(big[1:] & big[:-1]))
    tripled = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
    masked = _unmasked(lower) if _may_mask(np.frombuffer(lower.encode("ascii", "replace"), np.uint8)) else 0
    return [
        *(1000 * c / n for c in counts),
        float(len(strong)),
        float(len(kinds)),
        near,
        1000 * len(second) / n,
        capitals / max(1, letters),
        shouted / max(1, letters),
        (int(seen[33]) + int(seen[63])) / size,
        signs / size,
        float(np.count_nonzero(tripled)) / size,
        float(masked),
        float(np.log1p(n)),
        *lexicon.features(words),
    ]


class Trees:
    """Boosted trees of fixed depth; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        # Rare findings lie above nearly all quantiles; what is over zero gets cuts of its own.
        cuts = [np.unique(np.concatenate([c, np.quantile(v[v > 0], np.linspace(0, 0.9, 10)) * 0.999]) if (v > 0).any() else c) for c, v in zip(cuts, x.T)]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
        width = max(len(c) for c in cuts) + 1
        inner = 2**DEPTH - 1
        feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, 2**DEPTH))
        margin = np.full(len(y), base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), dtype=np.int64)
            for i in range(inner):
                rows = np.flatnonzero(node == i)
                best, chosen = LEAST_GAIN, None
                if len(rows) >= 2 * LEAST_LEAF:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for k in range(len(binned)):
                        b = binned[k][rows]
                        sg = np.cumsum(np.bincount(b, g[rows], width))[:-1]
                        sh = np.cumsum(np.bincount(b, h[rows], width))[:-1]
                        sn = np.cumsum(np.bincount(b, minlength=width))[:-1]
                        gain = sg**2 / (sh + RIDGE) + (total_g - sg) ** 2 / (total_h - sh + RIDGE) - total_g**2 / (total_h + RIDGE)
                        gain[(sn < LEAST_LEAF) | (len(rows) - sn < LEAST_LEAF)] = 0
                        j = int(gain.argmax())
                        if gain[j] > best:
                            best, chosen = float(gain[j]), (k, j)
                if chosen:
                    k, j = chosen
                    feature[t, i], cut[t, i] = k, cuts[k][j]
                    node[rows] = np.where(binned[k][rows] <= j, 2 * i + 1, 2 * i + 2)
                else:
                    node[rows] = 2 * i + 1
            at = node - inner
            step = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
            leaf[t] = step
            margin += step[at]
        return cls(base, feature, cut, leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = np.where(x[rows, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
            out += leaf[node - len(cut)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, shares): the best rising step function, by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    at, back = np.unique(margin[order], return_inverse=True)
    sums, sizes = np.bincount(back, y[order]).tolist(), np.bincount(back).tolist()
    blocks: list[list[float]] = []
    for m, s, n in zip(at.tolist(), sums, sizes):
        blocks.append([m, m, s, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            top = blocks.pop()
            blocks[-1][1:] = [top[1], blocks[-1][2] + top[2], blocks[-1][3] + top[3]]
    return np.array([v for b in blocks for v in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


class Model:
    def __init__(self, trees: Trees | None, at: np.ndarray, share: np.ndarray, lexicon: Lexicon | None = None):
        self.trees, self.at, self.share, self.lexicon = trees, at, share, lexicon or Lexicon()

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, kept_back: np.ndarray, lexicon: Lexicon | None = None) -> Model:
        if not len(y):
            return cls(None, np.zeros(1), np.zeros(1))
        if kept_back.all() or not kept_back.any():
            kept_back = np.arange(len(y)) % 4 == 3
        trees = Trees.fit(x[~kept_back], y[~kept_back])
        margin = trees.margin(x[kept_back]) if kept_back.any() else trees.margin(x)
        return cls(trees, *isotonic(margin, y[kept_back] if kept_back.any() else y), lexicon)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), self.at, self.share) if self.trees is not None else np.zeros(len(x))


def _counted(wanted: frozenset[str] | None):
    """Rows (unit, fold, n): how many texts of the task hold a unit, of all units or of those in `wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter[str]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for fold, counts in held.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([fold] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["unit", "fold", "n"])
            held.clear()

        for batch in batches:
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist()):
                found = _units_of(text.as_py() or "")
                held.setdefault(fold, Counter()).update(found if wanted is None else found & wanted)
                if sum(map(len, held.values())) > HELD_COUNTS:
                    yield from sent()
        yield from sent()

    return run


def _unit_counts(rows: DataFrame, least: int = 0, wanted: frozenset[str] | None = None) -> dict[str, list[int]]:
    """Of units that `least` texts hold or more, the number of texts of each fold."""
    each = rows.select("text", "fold").mapInArrow(tidy(_counted(wanted)), "unit string, fold int, n long")
    folds = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"f{f}") for f in range(FOLDS)]
    got = each.groupBy("unit").agg(*folds, F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    return dict(zip(got.column("unit").to_pylist(), zip(*(got.column(f"f{f}").to_pylist() for f in range(FOLDS)))))


def learn(rows: DataFrame) -> list[Lexicon]:
    """Lexicons of (text, y, fold): for each fold that of the others, and last the one of all."""
    sizes = {(r.fold, r.y > 0.5): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    toxic, clean = ([sizes.get((f, y), 0) for f in range(FOLDS)] for y in (True, False))
    if not sum(toxic):
        return [Lexicon()] * (FOLDS + 1)
    least = max(4, sum(toxic) // 100)
    p = _unit_counts(rows.filter("y > 0.5"), least)
    n = _unit_counts(rows.filter("y <= 0.5"), wanted=frozenset(p))
    out, none = [], (0,) * FOLDS
    for without in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != without]
        counts = {u: (sum(p[u][f] for f in folds), sum(n.get(u, none)[f] for f in folds)) for u in p}
        out.append(log_odds(counts, sum(toxic[f] for f in folds), sum(clean[f] for f in folds)))
    return out


def _featured(lexicons: list[Lexicon]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or "", lexicons[FOLDS if back else fold]) for t, fold, back in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["x", "y", "back"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: F.Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows. `train` says of a row of `labels` whether it may be used."""
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("_id").cast("string")).cast("binary"))
    usable = labels.filter(train) if train is not None else labels
    chosen = usable.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(key, "_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")  # `sample` rows at most
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("text")).cast("binary"))
    fold = (F.conv(F.substring(digest, 2, 1), 16, 10).cast("int") % FOLDS).alias("fold")
    rows = materialize(rows.select("text", fold, F.col("_y").alias("y"), F.substring(digest, 1, 1).isin(*"0123").alias("back")), "toxicity-sample")
    lexicons = learn(rows.filter("not back"))
    got = rows.mapInArrow(tidy(_featured(lexicons)), "x array<double>, y double, back boolean").toArrow()
    x = np.asarray(got.column("x").combine_chunks().flatten(), dtype=float).reshape(-1, len(FEATURES))
    y, kept_back = np.asarray(got.column("y")), np.asarray(got.column("back"))
    # Rows come in any order; sums of the same rows in one order are the same everywhere.
    order = np.lexsort([*x.T, y, kept_back]) if len(y) else np.zeros(0, np.int64)
    return Model.fit(x[order], y[order], kept_back[order].astype(bool), lexicons[FOLDS])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the score of each text in a last column, named `score_col` or, if there is one, longer."""
    columns = docs.columns
    new = free_name(docs, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for batch in batches:
            x = np.array([features(t.as_py() or "", model.lexicon) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*columns, new])

    schema = docs.schema
    return docs.mapInArrow(tidy(run), type(schema)([*schema.fields]).add(new, "double"))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_contract(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the query: only rows that aren't held out teach."""
    return fit(docs, labels, train=~held_out())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = fit_contract(docs, read_table(spark, sf_dir, "labels"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(slim, model).select("doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
