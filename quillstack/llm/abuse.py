"""Scoring documents for abusive, hateful or sexual content.

Every document becomes a row of dense features: densities and per-sentence peaks of word classes, nearness of the second person,
capitals, punctuation and obfuscation, and words learned from the verdicts of other documents. Boosted trees over histograms start from a plain sum of those peaks and learn the rest from human
verdicts on a bounded sample; isotonic regression on out-of-fold scores makes them probabilities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.lineage import scratch

#: Labelled documents used, at most, and the probability from which a document counts as abusive.
MOST_LABELLED, THRESHOLD = 20_000, 0.5
#: Verdicts that the prior score is worth.
PRIOR_VERDICTS = 4
#: Tokens either way in which the second person counts as near.
NEAR = 6

# Word classes. Words are lower case, without marks.
CLASSES = {
    "insult": """idiot idiots imbecile imbeciles moron morons stupid dumb dumbass dumbasses scumbag scumbags maggot maggots parasite loser losers clown pathetic worthless rotten vile ugly jerk prick bastard bastards bitch bitches asshole assholes
        whore whores slut sluts twat wanker retard retarded cretin coward liar lying dirtbag lowlife pig rat disgusting lousy idiota idiotas imbecil imbeciles estupido estupida asqueroso asquerosa cabron gilipollas puta puto hijo zorra cerdo inutil
        connard connards salope salaud encule abruti degueulasse sale pute batard arschloch schlampe hurensohn hure wichser dreckiges dreckiger drecksau schwein trottel dummkopf miserable filthy fat""",
    "profane": "shit shitty bullshit fuck fucking fucker motherfucker damn goddamn crap hell piss puke mierda joder hostia merde putain foutre gueule scheisse verdammt verpiss fresse cono carajo chingar",
    "threat": """kill killed hurt break smash burn choke strangle beat punch shoot stab regret rot die hang disappear destroy bleed
        matar rompo romper matare tuer casser crever buter schlag schlage umbringen toten brechen stech""",
    "hate": """vermin subhuman scum filth trash infest parasites savages cockroaches deport exterminate rats thief
        basura escoria echarlos ratas plaga vermine racaille ordure abschaum ungeziefer gesindel dreck""",
    "sexual": """naked nude nudes tits boobs cock dick pussy cunt fuck suck blowjob sex sexy horny panties slut whore bare ass breasts thighs lick moan orgasm porn
        desnuda desnudo tetas polla follar chupar nue nus seins bite baiser sucer cul nackt titten ficken blasen lecken geil""",
    "loose": """animals breed cages kind blood roof street people family trust thieves drop dead find sleep jaw throat bones dog face spread legs bed touching strip kiss desk climb underwear bedroom crawl rock kids belong disappear favor world
        cara partir figure fotos weg gehoren raus dehors cages hose""",
    "you": "you your yours yourself u ur ya te ti tu tus eres usted ustedes callate vete vous votre ton tes toi t'es du dich dir dein deine deiner euch",
    "me": "i me my myself we us yo mi conmigo mandame je moi ma mon ich mich mir mein",
    "them": "they them their those every never any all no nobody los les die ils leur ellos sind sont son",
    "sober": """witness testified testimony alleges alleged complaint statute covers medical chart biopsy benign exhibit survey registered plat plats counsel motion wire copper harassment supervisor rescission battery crimes
        threats insults made repeat trap kennel lane road statement officer quoted patient clinical diagnosis procedure court permit installed replaced structural assessment deadline""",
}
NAMES = list(CLASSES)
BAD = [NAMES.index(c) for c in ("insult", "profane", "threat", "hate", "sexual")]
YOU, ME, THEM, SOBER = (NAMES.index(c) for c in ("you", "me", "them", "sober"))
LEET = str.maketrans("@$10!345789", "asioieastbg")
_EDGE = ".,;:?\"'()[]{}<>«»“”‘’¿¡…-–—_|/\\&%#+=~`^"
_RUN = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class Lexicon:
    """Classes of raw tokens, remembered per worker."""

    WIDTH = len(NAMES) + 4  # classes, then obfuscated, capitals, exclamation, single letter

    def __init__(self, learned: dict[str, float] | None = None):
        self.learned = learned or {}
        self.keys: list[str] = []
        self.weights: list[float] = []
        self.words: dict[str, np.ndarray] = {}
        for k, name in enumerate(NAMES):
            for w in CLASSES[name].split():
                self.words.setdefault(plain(w), np.zeros(len(NAMES), np.uint8))[k] = 1
        self.masks: dict[tuple[str, str, int], str] = {}
        for w, v in self.words.items():
            if len(w) >= 4 and v[BAD].any():
                self.masks.setdefault((w[0], w[-1], len(w)), w)
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.ends: list[bool] = []

    def look(self, word: str) -> np.ndarray | None:
        got = self.words.get(word)
        if got is None and len(word) > 4 and word[-1] == "s":
            got = self.words.get(word[:-1])
        return got

    def add(self, token: str) -> int:
        row = np.zeros(self.WIDTH, np.uint8)
        bare = token.strip(_EDGE)
        low = plain(bare.lower())
        core = low.rstrip("!")
        got, hidden = self.look(core), False
        if got is None and core:
            if "*" in core or "#" in core:
                inner = core.strip("*#") if len(core.strip("*#")) == len(core) else core
                w = self.masks.get((inner[0], inner[-1], len(inner)))
                if w and all(a == b or a in "*#" for a, b in zip(inner, w)):
                    got, hidden = self.words[w], w
            elif not core.isalpha() and any(c.isalpha() for c in core):
                turned = low.translate(LEET)
                got = self.look(turned) if turned.isalpha() else None
                if got is None:
                    turned = core.translate(LEET).replace(".", "").replace("-", "").replace("_", "")
                    got = self.look(turned)
                hidden = turned if got is not None else False
            if got is None and _RUN.search(core):
                for short in (_RUN.sub(r"\1", core), _RUN.sub(r"\1\1", core)):
                    if (got := self.look(short.translate(LEET))) is not None:
                        hidden = short.translate(LEET)
                        break
        if got is not None:
            row[: len(NAMES)] = got
            row[len(NAMES)] = bool(hidden) and bool(got[BAD].any())
        row[len(NAMES) + 1] = len(core) > 1 and bare.isupper()
        row[len(NAMES) + 2] = token.endswith("!")
        row[len(NAMES) + 3] = len(bare) == 1 and bare.isalpha()
        key = hidden if isinstance(hidden, str) else core
        self.keys.append(key)
        self.weights.append(self.learned.get(key, 0.0))
        self.ids[token] = len(self.rows)
        self.rows.append(row)
        self.ends.append(token == "¶" or token.rstrip("\"'”)»").endswith((".", "!", "?")))
        return len(self.rows) - 1


def joined_letters(tokens: list[str]) -> list[str]:
    """Runs of three or more single letters become one word."""
    out, run = [], []
    for t in [*tokens, "¶"]:
        bare = t.strip(_EDGE + "!")
        if len(bare) == 1 and bare.isalpha() and t != "¶":
            run.append((bare, t))
            if t[-1] in ".!?,":
                pass
            continue
        if run:
            out += ["".join(b for b, _ in run) + (run[-1][1][-1] if run[-1][1][-1] in ".!?" else "")] if len(run) >= 3 else [x for _, x in run]
            run = []
        out.append(t)
    return out[:-1]


_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_]\s){2,}[^\W\d_](?=[\s.,!?]|$)")
PAIRS = [("insult", "you"), ("threat", "you"), ("threat", "me"), ("sexual", "you"), ("sexual", "me"), ("hate", "them"), ("insult", "profane"), ("insult", "threat"), ("insult", "hate"), ("insult", "insult"), ("hate", "hate"), ("sexual", "sexual"), ("profane", "you")]
FEATURES = (
    [f"rate_{n}" for n in NAMES] + [f"peak_{n}" for n in NAMES] + [f"both_{a}_{b}" for a, b in PAIRS]
    + ["learned_rate", "learned_peak", "learned_words", "near", "near_rate", "caps", "caps_bad", "shouts", "hidden", "hidden_rate", "worst", "worst_bad", "bad_sentences", "length"]
)


def features(texts: list[str], lex: Lexicon) -> np.ndarray:
    """A row of FEATURES per text; null and empty texts give zeros."""
    get, add = lex.ids.get, lex.add
    ids: list[int] = []
    sizes = []
    for t in texts:
        if not t:
            sizes.append(0)
            continue
        tokens = t.replace("\n", " ¶ ").split()
        if _SPACED.search(t):
            tokens = joined_letters(tokens)
        got = [i if (i := get(x)) is not None else add(x) for x in tokens]
        ids += got
        sizes.append(len(got))
    n = len(texts)
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not ids:
        return out
    at = np.array(ids)
    table, ends = np.stack(lex.rows), np.array(lex.ends)
    m = table[at].astype(np.int32)
    doc = np.repeat(np.arange(n), sizes)
    first = np.empty(len(at), bool)
    first[0] = True
    first[1:] = ends[at[:-1]] | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(first)
    sent = np.cumsum(first) - 1
    s = np.add.reduceat(m, begin, axis=0)
    size = np.diff(np.append(begin, len(at)))
    owner = doc[begin]
    k = len(NAMES)
    bad = (m[:, BAD] > 0).any(1)
    # Abusive tokens of the strong classes with the second person near, in the same sentence.
    you = np.concatenate([[0], np.cumsum(m[:, YOU])])
    lo, hi = np.maximum(begin[sent], np.arange(len(at)) - NEAR), np.minimum((begin + size)[sent], np.arange(len(at)) + NEAR + 1)
    near = bad & (you[hi] - you[lo] > 0)
    near_s = np.add.reduceat(near.astype(np.int32), begin)
    bad_s = np.add.reduceat(bad.astype(np.int32), begin)
    caps_s = s[:, k + 1] / size
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    here = owner[starts]
    words = np.maximum(1, np.bincount(doc, minlength=n))[here]
    peak = lambda x: np.maximum.reduceat(x, starts, axis=0)
    total = lambda x: np.add.reduceat(x, starts, axis=0)
    kinds = (s[:, BAD] > 0).sum(1)
    worst = bad_s + kinds + 0.7 * np.minimum(near_s, 2) + 0.5 * np.minimum(s[:, k], 2) + 0.5 * (s[:, THEM] > 0) * (s[:, NAMES.index("hate")] > 0) - 2.0 * s[:, SOBER] - 0.05 * np.maximum(0, size - 20)
    columns = [total(s[:, :k]) / words[:, None] * 100, peak(s[:, :k])]
    for a, b in PAIRS:
        x, y = s[:, NAMES.index(a)], s[:, NAMES.index(b)]
        columns.append(peak(np.maximum(0, x - 1) if a == b else np.minimum(x, y))[:, None])
    weight = np.array(lex.weights, np.float32)[at]
    known_s, many_s = np.add.reduceat(weight, begin), np.add.reduceat((weight > 1.5).astype(np.int32), begin)
    rest = [total(known_s) / words * 100, peak(known_s), peak(many_s), peak(near_s), total(near_s) / words * 100, total(s[:, k + 1]) / words, peak(caps_s * bad_s), total(s[:, k + 2]), peak(s[:, k]), total(s[:, k]) / words * 100,
            peak(worst), peak(bad_s - 2 * s[:, SOBER]), total((worst >= 2.5).astype(np.int32)), np.log1p(words)]
    out[here] = np.concatenate([*columns, *[r[:, None] for r in rest]], 1)
    return out


WORST = FEATURES.index("worst")


def prior(x: np.ndarray) -> np.ndarray:
    """Margin the trees start from: how bad the worst sentence looks."""
    return np.clip(1.1 * (x[:, WORST] - 2.6), -2.5, 2.5).astype(np.float64)


class Boosted:
    """Gradient-boosted trees for a logistic loss, grown on histograms of BINS bins."""

    BINS = 48

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.1, least: float = 40.0, ridge: float = 5.0, seed: int = 7):
        self.trees, self.depth, self.rate, self.least, self.ridge, self.seed = trees, depth, rate, least, ridge, seed

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.BINS)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        margin, self.model = prior(x), []
        n, p = b.shape
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-margin))
            use = rng.random(n) < 0.8
            g, h = w * (prob - y) * use, w * np.maximum(prob * (1 - prob), 1e-6) * use
            node = np.zeros(n, np.int64)
            split = np.full((2**self.depth - 1, 2), -1, np.int64)
            some = rng.permutation(p)[: max(8, p * 2 // 3)]
            for level in range(self.depth):
                base, k = 2**level - 1, 2**level
                best, where = np.full(k, 1e-3), np.full((k, 2), -1, np.int64)
                local = node - base
                gt, ht = np.bincount(local, g, k), np.bincount(local, h, k)
                for j in some:
                    m = len(self.cuts[j]) + 1
                    if m < 2:
                        continue
                    gs = np.bincount(local * m + b[:, j], g, k * m).reshape(k, m).cumsum(1)[:, :-1]
                    hs = np.bincount(local * m + b[:, j], h, k * m).reshape(k, m).cumsum(1)[:, :-1]
                    gr, hr = gt[:, None] - gs, ht[:, None] - hs
                    gain = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - (gt**2 / (ht + self.ridge))[:, None]
                    gain[(hs < self.least / 10) | (hr < self.least / 10)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(k), top]
                    better = value > best
                    best[better] = value[better]
                    where[better] = np.stack([np.full(k, j), top], 1)[better]
                split[base : base + k] = where
                f, c = where[local, 0], where[local, 1]
                right = (f >= 0) & (b[np.arange(n), np.maximum(f, 0)] > c)
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            k = 2**self.depth
            value = -np.bincount(leaf, g, k) / (np.bincount(leaf, h, k) + self.ridge) * self.rate
            self.model.append((split, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        out, rows = prior(x), np.arange(len(x))
        for split, value in self.model:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f, c = split[node, 0], split[node, 1]
                node = 2 * node + 1 + ((f >= 0) & (b[rows, np.maximum(f, 0)] > c))
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the rising function closest to ``y``: pooled neighbours that violate the order."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, c in zip(score[order], y[order], w[order]):
        blocks.append([s, v * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, v2, c2 = blocks.pop()
            blocks[-1] = [s2, blocks[-1][1] + v2, blocks[-1][2] + c2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Scorer:
    """Trees on top of the prior, and calibration. The prior counts as PRIOR_VERDICTS verdicts beside the given ones, so few of them change little."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.trees, self.verdicts = None, len(y)
        if len(y):
            fold = np.random.default_rng(11).integers(0, 4, len(y))
            held = np.zeros(len(y))
            for k in range(4):
                mine, rest = fold == k, fold != k
                held[mine] = Boosted().fit(x[rest], y[rest], w[rest]).margin(x[mine]) if rest.any() else prior(x[mine])
            self.trees = Boosted().fit(x, y, w)
            # A few prior cases at either end keep the calibration sane on few verdicts.
            ends = np.array([-3.0, 3.0])
            self.steps = isotonic(np.concatenate([held, ends]), np.concatenate([y, [0.0, 1.0]]), np.concatenate([w, [2.0, 2.0]]))

    def score(self, x: np.ndarray) -> np.ndarray:
        before = 1 / (1 + np.exp(-prior(x)))
        if self.trees is None:
            return before
        tops, values = self.steps
        return (self.verdicts * np.interp(self.trees.margin(x), tops, values) + PRIOR_VERDICTS * before) / (self.verdicts + PRIOR_VERDICTS)


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, votes): mean verdict per document, for at most MOST_LABELLED documents, in order of a hash of their id."""
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("toxic"), F.count(F.lit(1)).alias("votes"))
    return votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)


#: Parts the labelled documents are dealt to, so that no document is described by words learned from itself.
FOLDS = 4


def learned_words(counts: pd.DataFrame, pos: float, n: float) -> dict[str, float]:
    """Log-odds of words clearly commoner in abusive documents. ``counts`` has word, pos and n: documents, abusive ones counted in pos."""
    a, b = counts["pos"].to_numpy(float), (counts["n"] - counts["pos"]).to_numpy(float)
    odds = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (max(n - pos, 0) + 1))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    keep = (odds > 0.8) & (z > 3) & (a >= 4)
    return dict(zip(counts["word"][keep], np.minimum(odds[keep], 5.0).round(3)))


_LEXICONS: dict[int, Lexicon] = {}


def lexicon(learned: dict[str, float], name: int) -> Lexicon:
    """The worker's lexicon with these learned words; started afresh when it has grown large."""
    got = _LEXICONS.get(name)
    if got is None or got.learned != learned or len(got.rows) > 300_000:
        got = _LEXICONS[name] = Lexicon(learned)
    return got


def train(documents: DataFrame, labels: DataFrame) -> tuple[Scorer, dict[str, float]]:
    """Fit on the labelled documents. Counts of words and the documents' features reach the driver, not their texts."""
    keep = scratch(documents.sparkSession, "abuse")
    known = documents.select("doc_id", "text").join(F.broadcast(verdicts(labels)), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    known = keep.keep(known)

    def terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lex = lexicon({}, -1)
            rows = []
            for text, toxic, fold in zip(part["text"], part["toxic"], part["fold"]):
                tokens = joined_letters((text or "").replace("\n", " ¶ ").split())
                rows += [(w, fold, toxic) for w in {lex.keys[lex.ids[t] if t in lex.ids else lex.add(t)] for t in tokens} if w.isalpha()]
            yield pd.DataFrame(rows, columns=["word", "fold", "toxic"])

    counts = known.mapInPandas(terms, "word string, fold int, toxic double").groupBy("word", "fold").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    often = counts.groupBy("word").agg(F.sum("pos").alias("total")).where("total >= 4").select("word")
    got = counts.join(often, "word").toPandas()
    sizes = known.groupBy("fold").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).toPandas().set_index("fold")
    words = {}
    for k in [*range(FOLDS), FOLDS]:  # the last is without any fold left out
        some = got[got["fold"] != k].groupby("word", as_index=False)[["pos", "n"]].sum()
        rest = sizes[sizes.index != k]
        words[k] = learned_words(some, float(rest["pos"].sum()), float(rest["n"].sum())) if len(some) else {}

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, own in part.groupby("fold"):
                x = features(own["text"].tolist(), lexicon(words[int(k)], int(k)))
                yield pd.DataFrame({"doc_id": own["doc_id"], "toxic": own["toxic"], "votes": own["votes"], "x": list(x)})

    fitted = known.mapInPandas(rows, "doc_id long, toxic double, votes long, x array<float>").toPandas().sort_values("doc_id")
    if not len(fitted):
        return Scorer(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0)), {}
    return Scorer(np.stack(fitted["x"].to_numpy()), fitted["toxic"].to_numpy(float), np.sqrt(fitted["votes"].to_numpy(float))), words[FOLDS]


def abuse_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score) for every document; the score is the probability that it is abusive.

    Null and empty texts have no features and score as harmless. Null verdicts are ignored, several are averaged; without
    verdicts the prior scores. Repeated rows are scored each, extra columns ignored, an empty table gives no rows.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            model, words = shipped.value
            scores = model.score(features(part["text"].tolist(), lexicon(words, FOLDS))) if len(part) else np.zeros(0)
            yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "score": scores})

    return documents.select("doc_id", "source", "text").mapInPandas(rows, "doc_id long, source string, score double")
