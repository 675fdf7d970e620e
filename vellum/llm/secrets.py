"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, the path it
was found under and the words beside it. It is fitted on the driver from labelled findings, a sample whose bound is a
parameter, and sent to executors as arrays.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: bound of the labelled findings that the forest is fitted on
LABELLED = 6000
TREES, DEPTH, LEAST_LEAF, SEED = 40, 9, 4, 7
#: fixed values: formats that providers publish for their credentials
FORMATS = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "jwt": r"(?<![\w-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
}
# a name is one run of word characters, dots and hyphens, tried from its beginning alone and taken whole: time is linear in the text
NAMED = r"(?i:(?<![\w.-])(?=[\w.-]*?(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential))[\w.-]++)[\"']?\s*+(?:=>|:=|=|:)\s*+[\"']?(?P<named>[^\s\"',;]{6,}+)"
DENSE = r"(?<![\w+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])(?P<dense>[A-Za-z0-9_+/-]{16,}+={0,2})(?![\w+/-])"
PATTERN = re.compile("|".join([*(f"(?P<{k}>{p})" for k, p in FORMATS.items()), NAMED, DENSE]))
SECRET_WORDS = "token secret password passwd pwd key apikey credential credentials auth bearer login access private".split()
HARMLESS_WORDS = "example sample test dummy placeholder fake demo hash sha sha1 sha256 md5 checksum digest commit revision uuid id version etag changeme your insert todo".split()
#: words that cover a candidate where no corpus gives any
DICTIONARY = frozenset({*SECRET_WORDS, *HARMLESS_WORDS, *"user name value config string default local host admin root server client data file path url http https index table column number here null none true false this that with from have will when what which their there about other into time than only some could them also after first new work part place made over same help line turn move right think such large must even land here need house".split()} - {"id"})
#: most frequent words of a corpus that its dictionary holds, and the shortest and longest of them
DICTIONARY_WORDS, SHORTEST, LONGEST = 20_000, 4, 24
WORD = re.compile(r"[^\W\d_]{%d,%d}" % (SHORTEST, LONGEST))
HARMLESS_PATH = re.compile(r"(?i)test|example|sample|fixture|mock|doc|readme|spec|demo")
FEATURES = ["length", "transitions", "digits", "upper", "other", "distinct", "entropy", "longest_run", "hex", "covered", "placeholder", "format", "named", "harmless_path", "secret_beside", "harmless_beside"]
RESULT = "doc_id long, start long, length int, kind string, secret_sha256 string, score double, is_secret boolean"


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def covered(low: str, words: frozenset[str]) -> int:
    """Characters that dictionary words cover, the longest word from each place on, left to right."""
    at, n = 0, 0
    while at < len(low):
        if size := next((k for k in range(min(LONGEST, len(low) - at), 2, -1) if low[at : at + k] in words), 0):
            n += size
        at += size or 1
    return n


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> frozenset[str]:
    """DICTIONARY and up to `most` words, those that occur most often in the whole texts of docs; words of (nearly) equal counts
    are in together or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for t in b.column(0):
                n.update(WORD.findall((t.as_py() or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("level", F.floor(64 * F.log2("n")).cast("int")), "words")
    # levels of frequency from the top, as many as fit: a few thousand at most, whatever the vocabulary
    taken, lowest = 0, None
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
        taken += r.words
        if taken > most:
            break
        lowest = r.level
    return DICTIONARY | ({r.word for r in counts.where(F.col("level") >= lowest).select("word").collect()} if lowest is not None else set())


def features(candidate: str, kind: str, path: str | None, before: str, after: str, words: frozenset[str] = DICTIONARY) -> list[float]:
    n, kinds = len(candidate), [kind_of(c) for c in candidate]
    counts, run, longest = Counter(candidate), 1, 1
    for a, b in zip(candidate, candidate[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    beside = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", before)[-4:] + re.findall(r"[A-Za-z0-9]+", after)[:2]]
    parts = {p for w in beside for p in (w, *w.split("_"))}
    low = candidate.lower()
    return [
        n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        longest,
        float(all(c in string.hexdigits for c in candidate)),
        covered(low, words) / n,
        float(any(w in low for w in ("xxxx", "example", "changeme", "your", "placeholder", "****", "1234567", "abcdef"))),
        float(kind in FORMATS),
        float(kind == "named"),
        float(bool(path and HARMLESS_PATH.search(path))),
        float(any(s in p for p in parts for s in SECRET_WORDS)),
        float(any(w in parts for w in HARMLESS_WORDS)),
    ]


def candidates(text: str | None) -> Iterator[tuple[int, str, str, str, str]]:
    """(start, candidate, kind, words before, words after) of each match, left to right; matches do not overlap."""
    for m in PATTERN.finditer(text or ""):
        kind = m.lastgroup
        a, b = m.span(kind)
        yield a, text[a:b], kind, text[max(0, a - 60) : a], text[b : b + 30]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right and the share of secrets at each node."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += share[at]
        return out / max(1, len(self.trees))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_LEAF, seed: int = SEED) -> Forest:
    """A forest of Gini trees, each on a bootstrap sample, with the square root of the features tried at each node."""
    rng, made, tried = np.random.default_rng(seed), [], max(1, round(math.sqrt(x.shape[1])))

    def grow(rows: np.ndarray, level: int, nodes: list) -> int:
        me, p = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, p])
        if level == depth or p in (0.0, 1.0) or len(rows) < 2 * least:
            return me
        best = (1e-9, None, None)
        for f in rng.permutation(x.shape[1])[:tried]:
            v = x[rows, f]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 17)[1:-1]))
            for c in cuts:
                a = v <= c
                n = int(a.sum())
                if least <= n <= len(rows) - least:
                    pa_, pb = y[rows[a]].mean(), y[rows[~a]].mean()
                    gain = p * (1 - p) - (n * pa_ * (1 - pa_) + (len(rows) - n) * pb * (1 - pb)) / len(rows)
                    if gain > best[0]:
                        best = (gain, f, c)
        if best[1] is not None:
            a = x[rows, best[1]] <= best[2]
            nodes[me][:2] = [int(best[1]), float(best[2])]
            nodes[me][2] = grow(rows[a], level + 1, nodes)
            nodes[me][3] = grow(rows[~a], level + 1, nodes)
        return me

    for _ in range(trees if len(x) else 0):
        nodes: list = []
        grow(rng.integers(0, len(x), len(x)), 0, nodes)
        made.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return Forest(made)


def labelled_findings(n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(path, text, label) made by rule, half of them secrets: credentials of the formats above and random values that a
    name or a neighbour calls secret, against digests, identifiers, placeholders, dictionary words and versions."""
    rng, out = random.Random(seed), []
    pick = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    word = lambda: "".join(rng.choice(("ti", "er", "on", "an", "the", "ou", "st", "la", "de", "ra")) for _ in range(rng.randint(1, 4)))
    plain = sorted(DICTIONARY)
    wide, hexes, upper = string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_uppercase + string.digits
    good_paths, soft_paths = ("src/app/settings.py", "deploy/prod.env", "lib/client.rb", "config/main.yml", None), ("tests/fixtures/data.json", "docs/readme.md", "examples/demo.py", "lib/client.rb", None)
    for i in range(n):
        a, b = " ".join(word() for _ in range(3)), " ".join(word() for _ in range(2))
        if i % 2:
            name = rng.choice(("token", "password", "api_key", "secret", "SECRET_KEY", "db_password", "access_key", "auth_token"))
            mark = rng.choice(("=", " = ", ": ", ' = "', ":"))
            text = rng.choice((
                lambda: f"{a} AKIA{pick(upper, 16, 16)} {b}",
                lambda: f"{a} gh{rng.choice('pousr')}_{pick(wide, 36, 36)} {b}",
                lambda: f"{a} xoxb-{pick(string.digits, 10, 12)}-{pick(wide, 20, 26)} {b}",
                lambda: f"{a} sk_live_{pick(wide, 20, 30)} {b}",
                lambda: f"{a} AIza{pick(wide, 35, 35)} {b}",
                lambda: f"{a} eyJ{pick(wide, 12, 30)}.eyJ{pick(wide, 20, 60)}.{pick(wide, 30, 43)} {b}",
                lambda: f"{a} -----BEGIN {rng.choice(('RSA ', 'EC ', ''))}PRIVATE KEY----- {b}",
                lambda: "{0} -----BEGIN {1}PRIVATE KEY-----\n{2}\n-----END {1}PRIVATE KEY----- {3}".format(a, rng.choice(("RSA ", "EC ", "")), "\n".join(pick(wide + "+/", 64, 64) for _ in range(rng.randint(2, 26))), b),
                lambda: f"{a} {name}{mark}{pick(hexes, 16, 48)} {b}",
                lambda: f"{a} {name}{mark}{pick(wide + '!#%+', 10, 40)} {b}",
                lambda: f"{a} bearer {pick(wide, 24, 60)} {b}",
            ))()
            out.append((rng.choice(good_paths), text, 1))
        else:
            text = rng.choice((
                lambda: f"{a} {rng.choice(('commit', 'sha1', 'sha256', 'md5', 'checksum', 'digest', 'revision', 'etag'))}{rng.choice((' ', ': ', '='))}{pick(hexes, 32, 64)} {b}",
                lambda: f"{a} uuid {pick(hexes, 8, 8)}-{pick(hexes, 4, 4)}-4{pick(hexes, 3, 3)}-a{pick(hexes, 3, 3)}-{pick(hexes, 12, 12)} {b}",
                lambda: f"{a} {rng.choice(('password', 'token', 'api_key', 'secret'))}={rng.choice(('changeme', 'your_password_here', 'example-token', 'xxxxxxxxxxxx', '<password>', 'placeholder', 'test1234567', '************'))} {b}",
                lambda: f"{a} {rng.choice(('password', 'token', 'secret'))}: {rng.choice(('required', 'optional', 'string', 'config.value', 'os.environ[NAME]', 'get_token()', '${SECRET}', word() + word()))} {b}",
                lambda: f"{a} {'_'.join((rng.choice(plain), rng.choice(plain), rng.choice(plain), str(rng.randint(1, 99))))}_{word()}{word()} {b}",
                lambda: f"{a} version-{rng.randint(1, 20)}-{rng.randint(0, 99)}-{word()}{word()}{word()} {b}",
                lambda: f"{a} AKIA{rng.choice(('IOSFODNN7EXAMPLE', 'XXXXXXXXXXXXXXXX', '1234567890123456'))} example {b}",
                lambda: f"{a} https/static/{word()}/{rng.randint(1990, 2030)}/{word()}{word()}/{word()} {b}",
            ))()
            out.append((rng.choice(soft_paths), text, 0))
    return out


def findings_of(table: DataFrame, most: int = LABELLED) -> list[tuple[str | None, str, int]]:
    """The first `most` labelled findings of a table (path, text, label) by hash of path and text; null texts and labels are none."""
    t = table.where("text is not null and label is not null").select(F.col("path").cast("string"), F.col("text").cast("string"), F.col("label").cast("int"))
    return [tuple(r) for r in t.orderBy(F.xxhash64("path", "text"), "path", "text", "label").limit(most).collect()]


def forest_of(findings: list[tuple[str | None, str, int]], most: int = LABELLED, words: frozenset[str] = DICTIONARY) -> Forest:
    """Fitted on every candidate of the first `most` findings by hash of their text."""
    first = sorted(findings, key=lambda f: hashlib.sha256(f[1].encode("utf-8", "surrogatepass")).digest())[:most]
    rows = [(features(c, kind, path, a, b, words), label) for path, text, label in first for _, c, kind, a, b in candidates(text)]
    return fit(np.array([r[0] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def scan(docs: DataFrame, forest: Forest | None = None, path: str = "source", least: float = 0.5, words: frozenset[str] = DICTIONARY) -> DataFrame:
    """A row for each candidate in the whole text of each row of docs: doc_id, start, length, kind, secret_sha256, score, is_secret.

    start and length in code points, of the whole value however long it is, a private key with its body; the secret
    itself is not shown, only its digest. `path`: the column that says where the text is from, ignored if missing.
    `words`: the dictionary that the forest was fitted with. Null and empty texts have no rows; repeated rows have
    theirs each.
    """
    forest = forest or forest_of(labelled_findings(), words=words)
    sent = docs.sparkSession.sparkContext.broadcast((forest, words))
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, known = sent.value
        for b in batches:
            found, x = [], []
            for doc, t, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                for a, c, kind, before, after in candidates(t.as_py()):
                    found.append((doc, a, len(c), kind, hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest()))
                    x.append(features(c, kind, p, before, after, known))
            score = forest.scores(np.array(x, float).reshape(-1, len(FEATURES)))
            cols = list(zip(*found, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(score), pa.array(score >= least)], names=["doc_id", "start", "length", "kind", "secret_sha256", "score", "is_secret"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path")).mapInArrow(run, RESULT)
