"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import dataclasses
import functools
import json
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm import spans
from pelorus.llm.common import table

THRESHOLD = 0.5
REDACTED = "[SECRET]"
#: Labelled findings that a forest is trained from, at most; trees; depth.
MOST_FINDINGS = 20_000
TREES = 40
DEPTH = 12
CONTEXT = 80

NAMES = ("token", "secret", "passw", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey", "auth", "credential", "private_key", "private-key", "privatekey")
#: A name that says secret, of any length, an assignment, and its value: up to the closing quote, or of characters that stand in no quotes.
ASSIGNED = re.compile(
    r"(?<![\w.-])(?=[\w.-]*?(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key))[\w.-]++[\"']?+\s*+(?:=>|:=|=|:)\s*+"
    r"(?:\"(?P<double>(?:[^\"\\\n]|\\.){8,}+)\"|'(?P<single>(?:[^'\\\n]|\\.){8,}+)'|`(?P<back>[^`\n]{8,}+)`|[\"'`]?(?P<bare>[^\s\"'`,;<>|(){}\[\]]{8,}+))",
    re.I,
)
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
)
KNOWN_STARTS = ("AKIA", "gh", "xox", "k_live_", "k_test_", "AIza", "eyJ", "-----BEGIN")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_=-]{20,}+(?!@)")

NEAR_GOOD = {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "credentials", "login", "private"}
NEAR_BAD = {"example", "sample", "commit", "sha", "sha1", "sha256", "md5", "uuid", "guid", "id", "checksum", "hash", "digest", "version", "isbn", "etag", "order", "invoice", "placeholder", "dummy", "revision", "file", "integrity", "color", "class", "url"}
PATH_BAD = {"test", "tests", "example", "examples", "doc", "docs", "fixture", "fixtures", "sample", "samples", "spec", "mock", "vendor", "dist", "lock"}
PATH_GOOD = {"env", "config", "conf", "settings", "secrets", "credentials", "deploy", "yaml", "yml", "ini", "properties", "tfvars"}
#: The dictionary is the whole words of this vocabulary, of LEAST_WORD letters or more.
VOCABULARY = "word_bpe_49k.json"
LEAST_WORD = 4
#: Words that the made-up findings' names and placeholders are made of.
WORDS = (
    "about access again alpha angle answer array base best block body bound build cache camera case change child class client close code common connect "
    "context copy count custom date default demo detail document down edit empty engine example false file final first format from game get graph hash "
    "header help high home http import info insert john label large layer length library link load lock login main mark match member menu meta money more "
    "move network next null object open order output parent pass path place player power print process profile public range read region remote report "
    "return root row sample scale script second section send service share small sort space split state step store string super table team test that this "
    "todo tool track true under user version view web white word world year"
).split()


@functools.lru_cache(2)
def dictionary(path: str | None = None) -> frozenset[str]:
    """Words of a to z in a public vocabulary file (end-of-word tokens), and those of WORDS."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    words = (t.removesuffix(end) for t in model["vocab"] if t.endswith(end))
    return frozenset(w for w in (*words, *WORDS) if len(w) >= LEAST_WORD and w.isascii() and w.isalpha())


def _covered(low: str) -> list[str]:
    """Words of the dictionary in a text, the longest at each place, one after the other."""
    known, longest = dictionary(), _longest()
    found: list[str] = []
    for m in re.finditer(r"[a-z]{%d,}" % LEAST_WORD, low):
        at, end = m.start(), m.end()
        while at <= end - LEAST_WORD:
            for size in range(min(longest, end - at), LEAST_WORD - 1, -1):
                if low[at : at + size] in known:
                    found.append(low[at : at + size])
                    at += size
                    break
            else:
                at += 1
    return found


@functools.cache
def _longest() -> int:
    return max(map(len, dictionary()))


def _kind(c: str) -> str:
    return c if c.isascii() and c.isalpha() else "0" if c.isdigit() else "-"


@functools.cache
def _transitions() -> dict[str, float]:
    """Log probabilities of pairs of characters (lower case; digits and other characters as one each) in words."""
    pair: dict[str, float] = {}
    first: dict[str, float] = {}
    for w in dictionary():
        s = f"-{w}-"
        for a, b in zip(s, s[1:]):
            pair[a + b] = pair.get(a + b, 0) + 1
            first[a] = first.get(a, 0) + 1
    chars = "abcdefghijklmnopqrstuvwxyz0-"
    return {a + b: math.log((pair.get(a + b, 0) + 0.3) / (first.get(a, 0) + 0.3 * len(chars))) for a in chars for b in chars}


def _nearness(words: list[str], wanted: set[str]) -> float:
    """One over the place of the first word that is wanted."""
    return next((1 / k for k, w in enumerate(words, 1) if w in wanted), 0.0)


def features(value: str, rule: int, before: str, after: str, path: str) -> list[float]:
    """Length, character make-up and transitions, dictionary coverage, path and neighbouring words of a candidate."""
    n, low = len(value), value.lower()
    count = {c: value.count(c) for c in set(value)}
    digits, upper = sum(map(str.isdigit, value)), sum(map(str.isupper, value))
    letters = sum(map(str.isalpha, value))
    kinds = "".join(map(_kind, low))
    table_ = _transitions()
    steps = [table_.get(kinds[i : i + 2], -6.0) for i in range(n - 1)]
    known = _covered(low)
    switches = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(value, value[1:]))
    run = max((len(m[0]) for m in re.finditer(r"(.)\1*", value)), default=0)
    near = re.findall(r"[a-z0-9]+", before.lower())[-4:]
    behind = re.findall(r"[a-z0-9]+", after.lower())[:3]
    folders = set(re.findall(r"[a-z]+", path.lower()))
    return [
        n, digits / n, upper / n, (letters - upper) / n, (n - digits - letters) / n,
        -sum(k / n * math.log2(k / n) for k in count.values()),
        sum(steps) / max(1, len(steps)), min(steps, default=0.0), switches / n,
        sum(map(len, known)) / n, max(map(len, known), default=0),
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), len(count) / n, run / n,
        float(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low) is not None), float(value.count("/")), float(value.count("-") + value.count("_")),
        float(rule), _nearness(near[::-1], NEAR_GOOD), max(_nearness(near[::-1], NEAR_BAD), _nearness(behind, NEAR_BAD) / 2), float(bool(folders & PATH_BAD)), float(bool(folders & PATH_GOOD)),
    ]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of what looks like a secret, in order, without overlaps.

    Rules: 2 known form, 1 assigned to a name, 0 long token. Of two that overlap the higher rule stays,
    of one rule the first, then the longer.
    """
    found: list[tuple[int, int, int]] = []
    if any(s in text for s in KNOWN_STARTS):
        found += [(m.start(), m.end(), 2) for m in KNOWN.finditer(text)]
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(*m.span(m.lastgroup), 1) for m in ASSIGNED.finditer(text)]
    for m in GENERIC.finditer(text):
        value = m[0]
        if any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            found.append((m.start(), m.end(), 0))
    found.sort(key=lambda f: (-f[2], f[0], -f[1]))
    kept, taken = [], bytearray(len(text) if found else 0)
    for a, b, rule in found:
        if not any(taken[a:b]):
            kept.append((a, b, rule))
            taken[a:b] = b"\x01" * (b - a)
    return sorted(kept)


@dataclasses.dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left and right child, share of true findings."""

    trees: list[tuple[np.ndarray, ...]]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = f >= 0
                small = rows[np.arange(len(rows)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(go, np.where(small, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def fit_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Bagged trees, each split the best by Gini impurity among a random square root of the features."""
    rng, n, d = np.random.default_rng(seed), *rows.shape
    made = []
    for _ in range(trees):
        nodes: list[list] = []

        def grow(index: np.ndarray, level: int) -> int:
            me, y = len(nodes), labels[index]
            nodes.append([-1, 0.0, 0, 0, float(y.mean())])
            if level == depth or y.min() == y.max() or len(index) < 4:
                return me
            best = (1e9, -1, 0.0)
            for f in rng.choice(d, max(1, round(math.sqrt(d))), replace=False):
                order = np.argsort(rows[index, f], kind="stable")
                x, t = rows[index, f][order], np.cumsum(y[order])
                cut = np.flatnonzero(x[1:] > x[:-1])
                if len(cut):
                    k = cut + 1.0
                    p, q = t[cut] / k, (t[-1] - t[cut]) / (len(x) - k)
                    cost = k * p * (1 - p) + (len(x) - k) * q * (1 - q)
                    i = int(cost.argmin())
                    best = min(best, (float(cost[i]), int(f), float((x[cut[i]] + x[cut[i] + 1]) / 2)))
            if best[1] < 0:
                return me
            small = rows[index, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2] = grow(index[small], level + 1)
            nodes[me][3] = grow(index[~small], level + 1)
            return me

        grow(rng.integers(0, n, n), 0)
        made.append(tuple(np.array(c) for c in zip(*nodes)))
    return Forest(made)


def findings_fixture(n: int = 3000, seed: int = 5, without: tuple[int, ...] = ()) -> list[tuple[str, int, str, str, str, int]]:
    """Labelled findings (value, rule, before, after, path, label), made up: real forms of secrets and of what is taken for them.

    `without` names kinds (0 to 8) of what is taken for secrets that are left out.
    """
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda a, k: "".join(r.choice(a) for _ in range(k))
    phrase = lambda k: " ".join(r.choice(WORDS) if r.random() < 0.5 else some("aeionrstlhd", r.randint(2, 9)) for _ in range(k))
    case = lambda s: r.choice((s, s, s.upper()))
    out = []
    for i in range(n):
        good = i % 2 == 0
        path = r.choice(("", "", "src3", f"{r.choice(sorted(PATH_GOOD))}/{r.choice(WORDS)}.yaml", f"src/{r.choice(WORDS)}.py"))
        before, after, rule = phrase(6) + " ", " " + phrase(4), 0
        if good:
            kind = r.random()
            value = case(some(hexes, r.choice((32, 40, 40, 64)))) if kind < 0.45 else some(alnum + "+/_-", r.randint(20, 64)) if kind < 0.8 else some(alnum + "!#$%^&*", r.randint(12, 24))
            if kind > 0.93:
                value, rule = r.choice((f"AKIA{some(alnum[:26] + alnum[-10:], 16)}", f"ghp_{some(alnum, 36)}", f"sk_live_{some(alnum, 24)}", f"xoxb-{some('0123456789', 12)}-{some(alnum, 24)}")), 2
            elif kind < 0.12:
                before += r.choice(("", "Bearer ", "curl -H "))
            else:
                name = case(r.choice(("token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "passwd")))
                before, rule = before + name + r.choice((' = "', " = ", ': "', '="', ": ")), 1
                after = r.choice(('"', "", "'")) + after
        else:
            kind = r.choice([k for k in range(9) if k not in without])
            name = case(r.choice(("token", "secret", "password", "api_key", "auth")))
            if kind == 0:
                if r.random() < 0.3:
                    before += f'{name} = "{some(hexes, 40)}" {phrase(1)} '
                value, before = some(hexes, r.choice((32, 40, 64))), before + r.choice(("commit ", "sha256: ", "md5 ", "checksum = ", "revision ", "etag: ", "digest "))
            elif kind == 1:
                value, before = "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), before + r.choice(("", "uuid ", "id: ", "id = "))
            elif kind == 2:
                value = r.choice(("your_token_here", "changeme", "xxxxxxxxxxxxxxxx", "placeholder1", "********", "<token>", "example_password", "my-secret-key", "insert_api_key_here", "password123", "12345678", "00000000000000000000", "REPLACE_ME_1"))
                before, rule = before + name + r.choice((' = "', ": ")), 1
            elif kind == 3:
                value = r.choice("_-").join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + str(r.randint(0, 99))
            elif kind == 4:
                value = "/".join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + str(r.randint(0, 2030))
            elif kind == 5:
                value = "".join(r.choice(WORDS).title() for _ in range(r.randint(3, 6))) + str(r.randint(0, 99))
            elif kind == 6:
                value, rule = r.choice((f"os.environ.get", f"self.{r.choice(WORDS)}_{r.choice(WORDS)}", f"get_{r.choice(WORDS)}_{r.choice(WORDS)}", f"config.{r.choice(WORDS)}", phrase(1) + r.choice(WORDS))), 1
                before += name + r.choice((" = ", ": "))
            elif kind == 7:
                value = f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{r.choice(WORDS)}-{r.choice(WORDS)}-{r.choice(WORDS)}"
            else:
                value, path = case(some(hexes, r.choice((32, 40)))), f"{r.choice(sorted(PATH_BAD))}/{r.choice(WORDS)}.lock"
                before += r.choice(("integrity ", "hash ", "file "))
        out.append((value, rule, before[-CONTEXT:], after[:CONTEXT], path, int(good)))
    return out


@functools.lru_cache(2)
def default_forest() -> Forest:
    return train(findings_fixture())


def labelled_findings(findings: DataFrame, most: int = MOST_FINDINGS) -> list[tuple[str, int, str, str, str, int]]:
    """Findings for `train` from a table (text, start, end, rule, path, label): places in code points, rules as in RULES.

    At most `most` are taken, those with the least hashes; rows that are null in text, places or label don't count.
    """
    rows = findings.dropna(subset=["text", "start", "end", "label"]).where(F.col("start") < F.col("end"))
    at, to = F.col("start").cast("int"), F.col("end").cast("int")
    near = rows.select(
        F.substring("text", at + 1, to - at).alias("value"), F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, RULES)), F.col("rule")), F.lit(0)) - 1, F.lit(0)).cast("int").alias("rule"),
        F.substring("text", F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT))).alias("before"), F.substring("text", to + 1, F.lit(CONTEXT)).alias("after"),
        F.coalesce("path", F.lit("")).alias("path"), F.col("label").cast("int").alias("label"),
    )
    return [tuple(r) for r in near.orderBy(F.xxhash64(*near.columns), *near.columns).limit(most).collect()]


def train(findings: list[tuple[str, int, str, str, str, int]]) -> Forest:
    """A forest from labelled findings (value, rule, before, after, path, label), of which it takes MOST_FINDINGS at most."""
    if len(findings) > MOST_FINDINGS:
        findings = random.Random(1).sample(findings, MOST_FINDINGS)
    return fit_forest(np.array([features(*f[:5]) for f in findings]), np.array([f[5] for f in findings], float))


def scan_text(text: str, path: str, forest: Forest) -> list[tuple[int, int, int, float]]:
    found = candidates(text)
    if not found:
        return []
    rows = np.array([features(text[a:b], rule, text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path) for a, b, rule in found])
    return [(*f, float(s)) for f, s in zip(found, forest.predict(rows))]


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())]))
RULES = ("long token", "assigned to a name", "known form")


def scan(docs: DataFrame, forest: Forest | None = None, path: str | None = "source", threshold: float = THRESHOLD, redact: bool = False) -> DataFrame:
    """Findings in docs: doc_id, findings (start and end in code points, rule, score, secret), text.

    A finding is a secret if the forest gives it `threshold` or more. With redact, text has each
    secret replaced by REDACTED, else it is as given. `path` names the column with a document's path, if
    there is one. A null text is empty and has no findings; repeated rows have each their row; an
    empty table gives none. Texts are scanned whole.
    """
    forest = forest or default_forest()
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in spans.few(parts):
            rows, out = [], []
            for text, place in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                found = scan_text(text, place, forest)
                rows.append([{"start": a, "end": b, "rule": RULES[rule], "score": s, "secret": s >= threshold} for a, b, rule, s in found])
                if redact and found:
                    for a, b, _, s in reversed(found):
                        if s >= threshold:
                            text = text[:a] + REDACTED + text[b:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, FOUND), pa.array(out, pa.string())], ["doc_id", "findings", "text"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), where.alias("path"))
    return plain.mapInArrow(run, "doc_id long, findings array<struct<start: long, end: long, rule: string, score: double, secret: boolean>>, text string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    secrets = F.filter("findings", lambda f: f["secret"])
    digest = lambda f: F.sha2(F.substring("text", f["start"].cast("int") + 1, (f["end"] - f["start"]).cast("int")).cast("binary"), 256)
    return out.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.transform(secrets, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["rule"].alias("rule"), F.round(f["score"], 6).alias("score"), digest(f).alias("sha256"))).alias("secrets"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan as a pipeline stage: every document stays, secrets in its text are redacted (n_chars follows).

    A null text stays null; rows that repeat stay each; an empty table gives an empty one. Other columns
    stay as they are.
    """
    forest, names = default_forest(), docs.columns
    text_at, path_at = names.index("text"), names.index("source") if "source" in names else -1
    length_at = names.index("n_chars") if "n_chars" in names else -1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.few(parts):
            texts = part.column(text_at).to_pylist()
            paths = part.column(path_at).to_pylist() if path_at >= 0 else [""] * len(texts)
            length = part.column(length_at).to_pylist() if length_at >= 0 else []
            for i, (text, path) in enumerate(zip(texts, paths)):
                for a, b, _, s in reversed(scan_text(text or "", str(path or ""), forest)):
                    if s >= THRESHOLD:
                        texts[i] = texts[i][:a] + REDACTED + texts[i][b:]
                        if length:
                            length[i] = len(texts[i])
            columns = list(part.columns)
            columns[text_at] = pa.array(texts, part.schema.field(text_at).type)
            if length:
                columns[length_at] = pa.array(length, part.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
