"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is the value of an assignment, or a run of at least ``LEAST`` token
characters that holds a digit. The forest judges it by its length, the transitions
between its characters' classes, how much of it words of a dictionary (those that
most documents hold, ``dictionary_of``, and a few always known) cover, the
path of its document and the words next to it. Spark fits the forest on labelled
findings; the fitted nodes are read back as a table and sent to the tasks, so texts
are scanned, judged and redacted in one pass and are never shuffled.

Candidates reach to their natural end, however long, and names may be quoted, of
any length and any blanks away from : or =; finding them is linear in the text.

Null texts have no candidates and stay null; empty texts have none. A null path is
an empty one. Candidates do not overlap: runs that meet an assigned value are left to it.
Rows are scanned one by one, so null ids, ties, repeated rows and empty tables need
no care. Findings without both labels give a forest that keeps every candidate.
"""

from __future__ import annotations

import random
import re
import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.byte_words import most_held, words_of_texts
from ledgerlight.llm.cluster import fresh_path, materialize, shipped

LEAST = 16
#: Labelled findings that the forest is fitted on, at most (those of the smallest hash).
TRAIN_FINDINGS = 20_000
MASK = "[SECRET]"
FINDINGS = "candidate string, before string, after string, path string, label int"
#: What assigns: a name's last character, a quote that closes the name, blanks around : or = (a short break of line too), an opening quote, before a value.
_ASSIGNED = re.compile(r"(?<=[A-Za-z0-9_.\-])(?P<sep>[\"'`]?(?:[^\S\r\n]*|\s{0,2})[:=](?:[^\S\r\n]*|\s{0,2})[\"']?)(?=[^\s\"'`<>,;(){}]{6})")
_VALUE = re.compile(r"[^\s\"'`<>,;(){}]+")
_NAME = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_.\-]+\Z")
#: Runs of token characters to their end; the parts of a JSON web token are one run.
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_\-])eyJ[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+|[A-Za-z0-9+/_\-]{{{LEAST},}}={{0,2}}")
_DIGIT = re.compile("[0-9]")
_NEAR = 40

#: Words that the dictionary features know.
_WORDS = (
    "the and for with this that from have your you are not here key token secret password passwd user name value data file path test example sample demo "
    "dummy fake default change changeme placeholder insert replace none null true false string number version build release commit hash checksum order "
    "invoice phone card account page index image style class color table config server client local host http https www com org net html json xml"
).split()
#: Letters of a word of the dictionary.
_SHORTEST, _LONGEST = 3, 32
KNOWN = frozenset(w for w in _WORDS if len(w) >= _SHORTEST)
#: Words that a dictionary takes from documents, at most: those of the most texts.
MOST_WORDS = 20_000
_SECRET_WORDS = re.compile(r"pass|pwd|secret|token|api|key|auth|cred|bearer|private|signing|access", re.I)
_PLAIN_WORDS = re.compile(r"sha|commit|checksum|digest|md5|hash|uuid|guid|version|build|order|invoice|card|phone|isbn|tracking|revision|etag|id\b", re.I)
_QUIET_PATHS = re.compile(r"test|example|sample|fixture|mock|doc|lock|vendor|node_modules", re.I)
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abps]-|AIza|eyJ|npm_|hf_)")


def _assigned(text: str) -> list[tuple[int, int, str]]:
    found, at = [], 0
    while m := _ASSIGNED.search(text, at):
        start = m.start()
        while start > 0 and (text[start - 1] in "_.-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        name = _NAME.search(text[start : m.start()])
        if not name:
            at = m.end()
            continue
        end = _VALUE.match(text, m.end()).end()
        found.append((m.end(), end, name[0]))
        # What stands on the next line may be a name itself: "data:\n password: ..."
        at = end - 1 if "\n" in m["sep"] and text[end - 1] in ":=" else end
    return found


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name it is assigned to) of the candidates of a text, from left to right, whole and without overlap."""
    assigned, found, i = _assigned(text), [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        if not _DIGIT.search(text, a, b):
            continue
        while i < len(assigned) and assigned[i][1] <= a:
            i += 1
        # A run that lies in values is judged with them; what a run has before or behind is left to it.
        if i == len(assigned) or assigned[i][0] >= b:
            found.append((a, b, ""))
    return sorted(assigned + found)


def before_of(text: str, start: int, name: str) -> str:
    """What stands before a candidate, runs of blanks as one; of an assigned one the whole name and what stands before."""
    if not name:
        return text[max(0, start - _NEAR) : start]
    at = text.rfind(name, 0, start)
    return text[max(0, at - _NEAR) : at] + re.sub(r"\s+", " ", text[at:start])


def dictionary_of(docs: DataFrame, *, text_col: str = "text", most: int = MOST_WORDS, max_words: int = 200_000) -> frozenset[str]:
    """The words that most texts of ``docs`` hold, about ``most`` at most, with those that are always known. All texts are counted."""

    def tables(held):
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches):
        held: dict = {}
        for batch in batches:
            if len(held) > max_words:
                yield from tables(held)
                held = {}
            for texts in words_of_texts(batch.column(0)):
                for words in texts:
                    for w in set(words):
                        if _SHORTEST < len(w) <= _LONGEST:
                            held[w] = held.get(w, 0) + 1
        yield from tables(held)

    counted = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    return frozenset(most_held(materialize(counted, "secret-words"), F.col("n"), most).toArrow().column("word").to_pylist()) | KNOWN


def coverage(low: str, dictionary: frozenset[str]) -> float:
    """Share of a text that words of the dictionary cover, from left to right, the longest first."""
    at = held = 0
    while at < len(low):
        n = next((n for n in range(min(_LONGEST, len(low) - at), _SHORTEST - 1, -1) if low[at : at + n] in dictionary), 0)
        held += n
        at += n or 1
    return held / max(len(low), 1)


def features(candidate: str, before: str, after: str, path: str, dictionary: frozenset[str] = KNOWN) -> list[float]:
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    steps = [abs(ord(a) - ord(b)) for a, b in zip(candidate, candidate[1:], strict=False)]
    share = [kinds.count(k) / n for k in "duls"]
    low = candidate.lower()
    covered = coverage(low, dictionary)
    vowels = sum(c in "aeiou" for c in low) / n
    counts = np.array([candidate.count(c) for c in set(candidate)]) / n
    near = re.findall(r"[A-Za-z_]+", before)[-3:]
    last = near[-1] if near else ""
    return [
        float(n),
        changes / max(n - 1, 1),
        float(np.mean(steps)) if steps else 0.0,
        *share,
        float(-(counts * np.log2(counts)).sum()),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate))),
        float(bool(re.fullmatch(r"[0-9][0-9\-]*", candidate))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate))),
        float(bool(_PREFIX.match(candidate))),
        covered,
        vowels,
        float(bool(_SECRET_WORDS.search(last))),
        float(any(map(_SECRET_WORDS.search, near))),
        float(any(map(_PLAIN_WORDS.search, near))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(_QUIET_PATHS.search(path))),
        float("/" in candidate or "." in candidate),
        float(after[:1] in "\"'"),
    ]


def labelled_findings(spark: SparkSession, n: int = 3000, seed: int = 3) -> DataFrame:
    """A labelled set to start from: ``n`` findings of known shapes, secrets and what is mistaken for them."""
    rng = random.Random(seed)
    pick = lambda of, k: "".join(rng.choices(of, k=k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(_WORDS)
    syllables = lambda k: "".join(rng.choice(("er", "an", "tion", "ich", "eau", "ment", "ado", "sch", "ing", "ou")) for _ in range(k))
    named = lambda: rng.choice(("password", "passwd", "token", "secret", "api_key", "auth_token", "access_key", "client_secret"))
    quote = lambda: rng.choice(("", '"', "'"))

    def assigned(name, value, label):
        if rng.random() < 0.3:  # a quoted name, or one aligned with others
            q = rng.choice("\"'")
            shape = rng.choice((f"{{{q}{name}{q}: {q}", f"{q}{name}{q}:{q}", f"{syllables(2)} {q}{name}{q} : {q}", f"{syllables(2)} {syllables(9)}_{name} = {q}", f"{name} = {q}"))
            return value, shape, q + rng.choice(("}", ", ", " " + syllables(2))), label
        q = quote()
        return value, f"{syllables(2)} {name}{rng.choice(('=', ' = ', ': '))}{q}", q + " " + syllables(2), label

    def bare(value, near, label):
        return value, f"{syllables(3)} {near} ", " " + syllables(2), label

    def jwt():
        value = ".".join(("eyJ" + pick(alnum, 33), "eyJ" + pick(alnum + "-_", rng.choice((80, 300, 900))), pick(alnum + "-_", 43)))
        return assigned(named(), value, 1) if rng.random() < 0.5 else bare(value, rng.choice(("bearer", "token", syllables(2))), 1)

    secrets = (
        lambda: assigned(named(), pick(hexes, rng.choice((16, 18, 20, 24, 32, 40, 64))), 1),
        lambda: assigned(named(), pick(alnum, rng.randint(10, 48)), 1),
        lambda: assigned(named(), pick(alnum + "!@#%^*-_", rng.randint(8, 24)), 1),
        lambda: bare("AKIA" + pick(string.ascii_uppercase + "234567", 16), rng.choice(("key", syllables(2))), 1),
        lambda: bare("ghp_" + pick(alnum, 36), syllables(2), 1),
        lambda: bare("sk_live_" + pick(alnum, 24), syllables(2), 1),
        lambda: bare("AIza" + pick(alnum + "_-", 35), syllables(2), 1),
        lambda: bare(pick(alnum + "+/", 40), rng.choice(("secret", "key", "bearer")), 1),
        lambda: assigned(named(), pick(alnum + rng.choice(("", "+/", "-_", "%")), rng.choice((100, 201, 401, 900, 2500))), 1),
        lambda: assigned(named(), rng.choice(("hunter", "dragon", "monkey", "summer", "qwerty")) + pick(string.digits, rng.randint(1, 4)) + rng.choice("!@#$") + pick(string.ascii_lowercase, rng.randint(0, 6)), 1),
        lambda: jwt(),
        lambda: bare(pick(alnum + "+/", rng.choice((120, 401, 900, 2500))), rng.choice(("secret", "key", "bearer", "token")), 1),
    )
    plain = (
        lambda: bare(pick(hexes, 40), rng.choice(("commit", "revision", "sha")), 0),
        lambda: bare(pick(hexes, 64), rng.choice(("checksum", "digest", "hash")), 0),
        lambda: bare(pick(string.digits, rng.randint(16, 20)), rng.choice(("card", "order", "tracking", syllables(2))), 0),
        lambda: bare(str(uuid.UUID(int=rng.getrandbits(128))), rng.choice(("id", "uuid", syllables(2))), 0),
        lambda: bare(f"{word()}-{word()}-{word()}-{rng.randint(1, 2030)}", syllables(2), 0),
        lambda: bare(f"{word()}/{syllables(2)}/{word()}_{rng.randint(1, 99)}", syllables(2), 0),
        lambda: bare(syllables(rng.randint(5, 9)) + str(rng.randint(1, 99)), syllables(2), 0),
        lambda: assigned(named(), rng.choice(("changeme", "your_token_here", "xxxxxxxxxxxx", "placeholder", "example-password", "insert_key_here", "None", "default123", "${TOKEN}")), 0),
        lambda: assigned(rng.choice(("color", "version", "width", "title", "href", "url", "name", "date", syllables(3))), rng.choice((f"{word()}.{word()}", pick(string.digits, 8), f"https://{word()}.com/{word()}", syllables(4), f"{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}")), 0),
        lambda: bare("_".join((word(), word(), syllables(2), str(rng.randint(1, 99)))), rng.choice((syllables(2), "key", "name")), 0),
        lambda: bare("/".join(syllables(3) for _ in range(rng.randint(8, 60))) + str(rng.randint(1, 99)), rng.choice(("path", syllables(2))), 0),
        lambda: assigned(rng.choice(("sha256", "commit", "checksum", "etag", "build_id")), pick(hexes, rng.choice((32, 40, 64))), 0),
    )
    paths = ("src/app.py", "deploy/values.yaml", "config/prod.env", "", "main.go")
    rows = []
    for i in range(n):
        value, before, after, label = rng.choice(secrets if i % 2 else plain)()
        quiet = rng.random() < (0.05 if label else 0.3)
        rows.append((value, before, after, "tests/fixtures/sample.txt" if quiet else rng.choice(paths), label))
    return spark.createDataFrame(rows, FINDINGS)


class Forest:
    """Fitted trees as arrays: of each node the feature, threshold, children (-1: a leaf) and chance of a secret; and the dictionary they were fitted with."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], dictionary: frozenset[str] = KNOWN):
        self.trees, self.dictionary = trees, dictionary

    def chances(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.ones(len(x))
        total = np.zeros(len(x))
        for feature, threshold, left, right, chance in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := left[at] >= 0).any():
                goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += chance[at]
        return total / len(self.trees)


def train(findings: DataFrame, *, dictionary: frozenset[str] = KNOWN, trees: int = 40, depth: int = 8, seed: int = 3, max_findings: int = TRAIN_FINDINGS) -> Forest:
    """Fits the forest on labelled findings (``FINDINGS``); rows without a candidate or a label 0 or 1 are left out."""
    known = findings.filter("candidate is not null and candidate != '' and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Forest([], dictionary)
    place = F.pmod(F.xxhash64(F.lit(5), "candidate", "before"), F.lit(1 << 20)) / float(1 << 20)
    known = known.filter(place <= max_findings / sum(sizes.values()))

    def describe(batches):
        for batch in batches:
            c, b, a, p, y = (col.to_pylist() for col in batch.columns)
            x = [features(*[v or "" for v in row], dictionary) for row in zip(c, b, a, p, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], ["x", "label"])

    described = known.select("candidate", "before", "after", "path", "label").mapInArrow(describe, "x array<double>, label double")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(described.select(array_to_vector("x").alias("features"), "label"))
    path = fresh_path(findings.sparkSession, "secret-forest")
    model.write().save(path)
    nodes = findings.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    rows = nodes.select("treeID", "id", "leftChild", "rightChild", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), (F.col("impurityStats")[1] / (F.col("impurityStats")[0] + F.col("impurityStats")[1])).alias("chance")).orderBy("treeID", "id").collect()
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    column = lambda held, name, kind: np.array([-1 if r[name] is None else r[name] for r in held], kind)
    return Forest([tuple(column(t, c, k) for c, k in (("featureIndex", np.int64), ("threshold", np.float64), ("leftChild", np.int64), ("rightChild", np.int64), ("chance", np.float64))) for t in by_tree.values()], dictionary)


def train_for(docs: DataFrame, *, text_col: str = "text") -> Forest:
    """A forest fitted on the labelled set to start from, with the dictionary of these documents."""
    return train(labelled_findings(docs.sparkSession), dictionary=dictionary_of(docs, text_col=text_col))


def scan(docs: DataFrame, forest: Forest, *, threshold: float = 0.5, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Adds secret_candidates, secrets (array of start, end, score) and redacted to the rows of ``docs``. No shuffle."""
    spark = docs.sparkSession
    held = shipped(spark, forest)
    names = [f"c{i}" for i in range(len(docs.columns))]
    added = {"secret_candidates": "bigint", "secrets": "array<struct<start: bigint, end: bigint, score: double>>", "redacted": "string"}
    text_at = docs.columns.index(text_col)
    path_at = docs.columns.index(path_col) if path_col else None

    def run(batches):
        forest = held()
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            paths = batch.column(path_at).to_pylist() if path_at is not None else [""] * len(texts)
            spans = [candidates(t or "") for t in texts]
            x = [features(t[a:b], before_of(t, a, name), t[b : b + _NEAR], str(p or ""), forest.dictionary) for t, p, of in zip(texts, paths, spans, strict=True) for a, b, name in of]
            chance = forest.chances(np.array(x)) if x else np.zeros(0)
            found, redacted, i = [], [], 0
            for t, of in zip(texts, spans, strict=True):
                mine = [{"start": a, "end": b, "score": float(c)} for (a, b, _), c in zip(of, chance[i : i + len(of)], strict=True) if c >= threshold]
                i += len(of)
                at, parts = 0, []
                for s in mine:
                    parts += [t[at : s["start"]], MASK]
                    at = s["end"]
                found.append(mine)
                redacted.append("".join([*parts, t[at:]]) if mine else t)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in spans], pa.int64()), pa.array(found, kind), pa.array(redacted, pa.string())], [*names, *added])

    schema = ", ".join([f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)] + [f"{n} {t}" for n, t in added.items()])
    out = docs.toDF(*names).mapInArrow(run, schema)
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in added]
    return out.select(*kept, *added)


def redact(docs: DataFrame, forest: Forest, *, text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with its secrets masked, the same columns whatever their names; ``n_chars`` follows the text where there is such a column."""
    columns = docs.columns
    plain = {c: f"c{i}" for i, c in enumerate(columns)}
    scanned = scan(docs.toDF(*plain.values()), forest, threshold=threshold, text_col=plain[text_col], path_col=path_col and plain[path_col])
    out = {c: F.col(n) for c, n in plain.items()} | {text_col: F.col("redacted")}
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(F.size("secrets") > 0, F.length("redacted").cast(kind)).otherwise(out["n_chars"])
    return scanned.select(*[out[c].alias(c) for c in columns])
