"""Operator 8, secret scans: candidates by pattern, false positives removed by a random forest, in built-in functions.

A candidate is a run of 16 or more key characters inside a word, or a run of any length and make-up that a key name and an
assignment (or "is"), "Bearer", a known prefix or the login of a URL point to. Its features are its length and make-up, the mean log-odds of its
character transitions (learnt from the labelled findings), how much of it dictionary words cover (the words that most
documents of the corpus hold, counted over all of it), whether it stands in a path, a login, a hook's address, quotes or an
assignment, and its neighbouring words. The forest is trained on labelled findings and kept as arrays of nodes that one
expression walks, whatever its size, so that finding, scoring and redacting are a projection of each document's own row:
no exchange, no Python on the executors.

Training reads a bounded table of findings (label 0 or 1, word, before_2, before_1, after). The tables here hold no such
labels, so `example_findings` makes them by rule, in families; `fit` takes any others. `by_family` says how a forest does on
families that it was not trained on.

Defined results: a null or empty text has no candidates and stays as it is; the same secret twice gives two findings;
repeated rows are scanned alike; an empty table gives no rows; without labelled findings of both kinds nothing is taken for
a secret; a corpus without words leaves the dictionary empty; further columns pass through `redact`.
"""

from __future__ import annotations

import dataclasses
import functools
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words_of

RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
KEYS = r"(?i)(token|secret|passw|passphrase|(?<![a-z])pass(?![a-z])|pwd|api.?key|access.?key|auth|bearer|credential|private)"
BENIGN = r"(?i)(commit|sha\d*|md5|checksum|digest|uuid|guid|hash|revision|etag|version|build|order|invoice|example|image|serial|tracking)"
PREFIX = r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|npm_|xox[abp]-|sk_live_|sk-|AIza|eyJ)"
PREFIXES = "^" + PREFIX
#: A key name and what may follow it up to its assignment.
NAMED = r"(?i)(?:token|secret|passw|passphrase|(?<![a-z])pass(?![a-z])|pwd|api.?key|access.?key|auth(?!or)|credential|private.?key)[A-Za-z0-9_.\-]*[\"'\])]*"
#: The password of a URL with a login.
LOGIN = r"://[^\s/:@]*:([^\s/@]+)@"
#: What stands between a name and its value in prose.
MEANS = ["is", "was", "are", "ist", "est", "es"]
HOOK = "(?i)hook"
#: Characters as transitions see them: letters without their case, digits as one, all others as one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-"
#: Words, letter pairs and syllables that example findings are made of.
DICTIONARY = "the and for you that with this from have not are was will your about example sample test demo user name file data page index image public static assets content article section chapter version release download report document summary order number house world people service product company system network language history".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
#: Syllables of English, German, French and Spanish words, for words in capitals.
SYLLABLES = "ment tion que aire elle eux vich pa ait schung auf sch heit keit lich ung der die ein ver dad cion ando mente por ble ness ing ship con pre able est ich leai aus les des est ois".split()
FEATURES = ["length", "distinct", "digits", "upper", "lower", "changes", "hex", "transitions", "dictionary", "path", "keyed", "benign", "prefix", "assigned", "quoted", "symbols", "login", "hook", "prose"]


def pointed(x: Column, before_2: Column, before_1: Column) -> Column:
    """The run in a word that a key name with an assignment or "is", "Bearer", a known prefix or a login points to; empty if there is none."""
    inside = F.regexp_extract(x, NAMED + "[=:]+>?[\"'`]*([^\"'`]+)", 1)
    ahead = before_1.rlike(NAMED + "[=:]+>?$") | (before_1.rlike("^[=:]+>?$") & before_2.rlike(NAMED + "$")) | before_1.rlike("(?i)^[\"'`]?bearer$") | (before_1.rlike(NAMED + "$") & x.rlike("^[=:]")) | (before_1.isin(MEANS) & before_2.rlike(NAMED + "$"))
    after = F.when(ahead, F.regexp_extract(x, "^[=:>\"'`(\\[{]*([^\"'`]+)", 1)).otherwise("")
    prefixed = F.regexp_extract(x, f"(?:^|[^A-Za-z0-9])({PREFIX}[^\"'`,;()<>]+)", 1)
    found = F.when(inside != "", inside).when(after != "", after).when(prefixed != "", prefixed).otherwise(F.regexp_extract(x, LOGIN, 1))
    return F.when(x.rlike("[\"'`][,;.)}\\]]*$"), found).otherwise(F.regexp_replace(found, "(?<=[^.,;:)}\\]])[.,;:)}\\]]+$", ""))


def runs_of(x: Column, before_2: Column, before_1: Column) -> Column:
    """array<string>: the candidates of a word, the one pointed to first; of two that overlap the longer one."""
    long_ = F.when(F.length(x) >= 16, F.regexp_extract_all(x, F.lit(RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def both(p: Column) -> Column:
        covered = F.exists(long_, lambda r: F.contains(r, p) & (F.length(r) > F.length(p)))
        return F.when((p == "") | covered, long_).otherwise(F.concat(F.array(p), F.filter(long_, lambda r: ~F.contains(p, r))))

    return let(pointed(x, before_2, before_1), both)


def candidates(text: Column) -> Column:
    """array<struct> of the runs of a text: the run, what its word holds before it, its neighbours and the word's number."""

    def look(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            near = lambda k: F.coalesce(F.get(w, i + k), F.lit(""))
            made = F.transform(runs_of(x, near(-2), near(-1)), lambda r: F.struct(r.alias("run"), F.call_function("substring_index", x, r, F.lit(1)).alias("lead"), near(-2).alias("before_2"), near(-1).alias("before_1"), near(1).alias("after"), i.cast("long").alias("word_no")))
            hint = x.rlike(f"[=:]|{PREFIX}") | near(-1).rlike("(?i)[=:]>?$|bearer$") | (near(-1).isin(MEANS) & near(-2).rlike(NAMED + "$"))
            return F.when((F.length(x) >= 16) | hint, made)

        return F.flatten(F.array_compact(F.transform(w, one)))

    return let(words_of(text), look)


def dictionary(docs: DataFrame, text: str = "text", size: int = 1000) -> tuple[str, ...]:
    """The `size` words of 4 to 14 letters that most documents hold; counted over all texts with map-side combining."""
    words = F.array_distinct(F.filter(words_of(F.lower(text)), lambda w: w.rlike("^[a-z]{4,14}$")))
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").count().where("count > 1")
    return tuple(r["w"] for r in counted.orderBy(F.desc("count"), "w").limit(size).collect())


def symbol(ch: str) -> int:
    """The place of a character in ALPHABET."""
    return ALPHABET.index(ch) if ch in ALPHABET[:26] else 26 if ch.isdigit() else 27


def transition_odds(runs: list[str], labels: list[int]) -> tuple[float, ...]:
    """For every pair of characters the log of how much likelier it is in secrets than in other runs, smoothed by one."""
    n = len(ALPHABET)
    counts = np.ones((2, n * n))
    for run, label in zip(runs, labels, strict=True):
        at = [symbol(ch) for ch in run.lower()]
        np.add.at(counts[int(label)], np.array(at[:-1], int) * n + np.array(at[1:], int), 1)
    share = counts / counts.sum(axis=1, keepdims=True)
    return tuple(np.log(share[1] / share[0]).round(4).tolist())


@dataclasses.dataclass(frozen=True)
class Known:
    """What features are measured by: the dictionary and the log-odds of transitions."""

    words: tuple[str, ...]
    odds: tuple[float, ...]


def numbers(values: list, kind: str) -> Column:
    """array<kind>: a constant, handed over as one string."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def transitions(run: Column, odds: tuple[float, ...]) -> Column:
    """The mean log-odds of the transitions of a run."""
    table, low, n = numbers(list(odds), "double"), F.lower(run), len(ALPHABET)

    def symbol_of(i: Column) -> Column:
        ch = F.substring(low, i, F.lit(1))
        return F.when(ch.rlike("[a-z]"), F.ascii(ch) - 97).when(ch.rlike("[0-9]"), 26).otherwise(27)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(table, symbol_of(i) * n + symbol_of(i + 1)), F.lit(0.0)))
    return F.when(F.length(run) > 1, total / (F.length(run) - 1)).otherwise(0.0)


def features(c: Column, known: Known) -> Column:
    """array<double>: the features of a candidate, in the order of FEATURES."""
    listed = F.lit(f"({'|'.join(sorted(known.words, key=lambda w: (-len(w), w)))})")
    run, lead = c["run"], c["lead"]
    n = F.length(run).cast("double")
    share = lambda rx: F.regexp_count(run, F.lit(rx)) / n
    flag = lambda b: b.cast("double")
    near = F.concat_ws(" ", c["before_2"], c["before_1"], lead)
    values = [
        n, F.size(F.array_distinct(F.split(run, ""))).cast("double"), share("[0-9]"), share("[A-Z]"), share("[a-z]"),
        share("(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[A-Za-z0-9])(?=[_/+-])"), flag(run.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        transitions(run, known.odds), 1 - F.length(F.regexp_replace(F.lower(run), listed, F.lit(""))) / n if known.words else F.lit(0.0),
        flag(lead.rlike(r"[/\\]") | run.rlike("/.*/")), flag(near.rlike(KEYS)), flag(F.concat_ws(" ", near, c["after"]).rlike(BENIGN)), flag(run.rlike(PREFIXES)),
        flag(lead.rlike("[=:]\\s*[\"']?$") | (lead.rlike("^[\"']?$") & c["before_1"].rlike("[=:]$"))),
        flag(lead.rlike("[\"'`]$")), share("[^A-Za-z0-9]"),
        flag(lead.rlike("://[^/:@]*:$")), flag(F.concat(lead, run).rlike(HOOK)), flag(c["before_1"].isin(MEANS) & c["before_2"].rlike(NAMED + "$")),
    ]
    return F.array(*values)


@dataclasses.dataclass(frozen=True)
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int = 5) -> Node:
    """A tree that splits by Gini impurity, each time over a random choice of features."""
    value = float(y.mean())
    if depth == 0 or len(y) < 2 * least or value in (0.0, 1.0):
        return Node(value)
    best = (np.inf, -1, 0.0)
    for f in rng.choice(x.shape[1], 5, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        ones = np.cumsum(t)[:-1]
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(t) - n >= least)
        if ok.any():
            rest, m = t.sum() - ones, len(t) - n
            impurity = np.where(ok, ones * (n - ones) / n + rest * (m - rest) / m, np.inf)
            i = int(impurity.argmin())
            best = min(best, (float(impurity[i]), int(f), float((v[i] + v[i + 1]) / 2)))
    if best[1] < 0:
        return Node(value)
    low = x[:, best[1]] <= best[2]
    return Node(value, best[1], best[2], grow(x[low], y[low], depth - 1, rng), grow(x[~low], y[~low], depth - 1, rng))


@dataclasses.dataclass(frozen=True)
class Forest:
    trees: tuple[Node, ...]
    known: Known

    def nodes(self) -> tuple[list[int], list[tuple]]:
        """The numbers of the roots, and (feature, cut, low, high, value) of every node; a leaf leads to itself."""
        roots, listed = [], []

        def put(node: Node) -> int:
            at = len(listed)
            listed.append((0, 0.0, at, at, node.value))
            if node.low is not None:
                listed[at] = (node.feature, node.cut, put(node.low), put(node.high), node.value)
            return at

        for tree in self.trees:
            roots.append(put(tree))
        return roots, listed

    def depth(self) -> int:
        down = lambda node: 0 if node.low is None else 1 + max(down(node.low), down(node.high))
        return max(map(down, self.trees), default=0)

    def score(self, c: Column) -> Column:
        """The share of the trees that take a candidate for a secret; 0 without trees."""
        if not self.trees:
            return F.lit(0.0)
        return let(features(c, self.known), self.vote)

    def vote(self, f: Column) -> Column:
        roots, listed = self.nodes()
        feature, cut, low, high, value = (numbers(list(x), kind) for x, kind in zip(zip(*listed), ("int", "double", "int", "int", "double"), strict=True))
        steps = numbers([0] * self.depth(), "int") if self.depth() else F.array().cast("array<int>")
        leaf = lambda root: F.aggregate(steps, root, lambda at, _: F.when(F.get(f, F.get(feature, at)) <= F.get(cut, at), F.get(low, at)).otherwise(F.get(high, at)))
        return F.aggregate(numbers(roots, "int"), F.lit(0.0), lambda total, root: total + F.get(value, leaf(root))) / len(self.trees)


def fit(findings: DataFrame, words: tuple[str, ...] = tuple(DICTIONARY), trees: int = 25, depth: int = 7, max_findings: int = 20_000, seed: int = 3) -> Forest:
    """A forest from labelled findings (word, before_2, before_1, after, label); at most `max_findings` of them are taken."""
    word = F.coalesce("word", F.lit(""))
    run = F.coalesce(F.get(runs_of(word, F.coalesce("before_2", F.lit("")), F.coalesce("before_1", F.lit(""))), 0), F.lit(""))
    c = F.struct(run.alias("run"), F.when(run == "", "").otherwise(F.call_function("substring_index", word, run, F.lit(1))).alias("lead"), *[F.coalesce(k, F.lit("")).alias(k) for k in ("before_2", "before_1", "after")])
    rows = findings.where(F.col("label").isin(0, 1)).select(c.alias("c"), "label").where("c.run <> ''").orderBy(F.xxhash64("c"), "label").limit(max_findings).select("c", "label").collect()
    labels = [r["label"] for r in rows]
    known = Known(words, transition_odds([r["c"]["run"] for r in rows], labels))
    if len(set(labels)) < 2:
        return Forest((), known)
    taken = findings.sparkSession.createDataFrame([(*r["c"], r["label"]) for r in rows], "run string, lead string, before_2 string, before_1 string, after string, label int")
    rows = taken.select(features(F.struct("run", "lead", "before_2", "before_1", "after"), known).alias("f"), "label").collect()
    x, y = np.array([list(r["f"]) for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], float)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        grown.append(grow(x[pick], y[pick], depth, rng))
    return Forest(tuple(grown), known)


def example_findings(spark: SparkSession, n: int = 12000, seed: int = 11) -> DataFrame:
    """Labelled findings by rule: keys in their usual settings against hashes, names, numbers, paths and placeholders, each of a family."""
    r = random.Random(seed)
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    cased = lambda s: r.choice([s, s.upper()])
    mixed = lambda k: "".join(r.choices(string.ascii_letters + string.digits, k=k))
    upper = lambda k: "".join(r.choices(string.ascii_uppercase + "234567", k=k))
    plain = lambda: "".join(r.choices(PAIRS, k=r.randint(1, 4)))
    name = lambda: r.choice(["token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "pwd", "private_key"])
    heading = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(4, 8))).upper()
    letters = lambda k: "".join(r.choices(string.ascii_letters, k=k))
    short = lambda: r.choice([lambda: mixed(r.randint(8, 15)), lambda: letters(r.randint(8, 15)), lambda: "".join(r.choices(string.ascii_letters + string.digits + "!@#$%^&*.?+", k=r.randint(6, 24))), lambda: plain() + r.choice(["", "!", "#", "@"]) + str(r.randint(0, 9999)) + r.choice(["", "!", "$"])])()
    word = lambda: r.choice([plain, lambda: r.choice(DICTIONARY), lambda: plain().capitalize()])()
    quote = lambda s: r.choice(['"%s"', "'%s'", "%s", '"%s",'])  % s
    key = lambda: r.choice([lambda: hexes(r.choice([18, 20, 24, 32, 40, 64])), lambda: mixed(r.randint(16, 64)), lambda: "ghp_" + mixed(36), lambda: "sk_live_" + mixed(24), lambda: upper(r.randint(20, 32)), lambda: letters(r.randint(16, 40)), short])()
    digits = lambda k: "".join(r.choices(string.digits, k=k))
    scheme = lambda: r.choice(["postgres", "postgresql", "mysql", "mongodb", "redis", "amqp", "https", "ftp", "smtp"])
    host = lambda: r.choice(["localhost", "db", "10.0.0.7", plain() + ".example.com", "hooks.slack.com", plain() + "." + plain() + ".net"]) + r.choice(["", "", f":{r.randint(80, 9999)}"])
    benign = lambda: r.choice(["commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "revision", "etag", "build", "order", "serial"])
    found = {
        "assigned": lambda: (plain(), plain(), f"{name()}{r.choice('=:')}{quote(key())}", plain()),
        "spaced": lambda: (name(), r.choice("=:"), quote(key()), plain()),
        "named": lambda: (plain(), name() + r.choice(["=", ":"]), quote(key()), plain()),
        "aws": lambda: (plain(), plain(), r.choice(["AKIA", "ASIA"]) + upper(16), plain()),
        "github": lambda: (plain(), plain(), r.choice(["ghp_", "gho_"]) + mixed(36), plain()),
        "aws_letters": lambda: (plain(), plain(), r.choice(["AKIA", "ASIA"]) + "".join(r.choices(string.ascii_uppercase, k=16)), plain()),
        "spaced_short": lambda: (name(), r.choice("=:"), quote(short()), plain()),
        "assigned_short": lambda: (plain(), plain(), f"{name()}{r.choice('=:')}{quote(short())}", plain()),
        "quoted_short": lambda: (plain(), name() + r.choice("=:"), r.choice(['"%s"', "'%s'"]) % r.choice([short(), plain() + plain()]), plain()),
        "bearer": lambda: (r.choice(["Authorization:", plain()]), "Bearer", mixed(r.randint(24, 80)), plain()),
        "quoted_words": lambda: (plain(), name() + r.choice("=:"), r.choice(['"%s"', "'%s'"]) % (plain() * r.randint(2, 3)), plain()),
        "pem_first": lambda: ("PRIVATE", "KEY-----", mixed(64), mixed(64)),
        "pem": lambda: (mixed(64), mixed(64), mixed(64), r.choice([mixed(64), "-----END"])),
        "slack": lambda: (plain(), plain(), quote(f"xox{r.choice('abp')}-{digits(r.randint(10, 13))}-{digits(r.randint(10, 13))}-{mixed(r.randint(20, 32))}"), plain()),
        "gitlab": lambda: (plain(), plain(), quote(r.choice(["glpat-", "npm_", "github_pat_"]) + mixed(r.choice([20, 36]))), plain()),
        "payment": lambda: (plain(), plain(), quote(r.choice(["sk_live_", "sk-", "sk-proj-"]) + mixed(r.randint(20, 48))), plain()),
        "maps": lambda: (plain(), plain(), quote("AIza" + "".join(r.choices(string.ascii_letters + string.digits + "-_", k=35))), plain()),
        "jwt": lambda: (plain(), plain(), quote("eyJ" + ".".join(mixed(r.randint(20, 60)) for _ in range(3))), plain()),
        "login": lambda: (plain(), plain(), f"{r.choice(['', name() + '=', 'url='])}{scheme()}://{word()}:{r.choice([short, lambda: mixed(r.randint(8, 24))])().replace('@', '!')}@{host()}", plain()),
        "hook": lambda: (plain(), plain(), f"https://{r.choice(['hooks.' + host(), host() + '/webhook', host() + '/api/webhooks', host() + '/hooks'])}/{r.choice([lambda: f'services/T{upper(8)}/B{upper(8)}/{mixed(24)}', lambda: f'{digits(18)}/{mixed(68)}', lambda: mixed(r.randint(20, 40))])()}", plain()),
        "prose": lambda: (r.choice(["password", "passphrase", "token", "pwd", "secret", "Password", "key_token"]), r.choice(MEANS[:3]), quote(r.choice([short, lambda: mixed(r.randint(8, 24))])()) + r.choice(["", "."]), plain()),
        "environment": lambda: ("export", plain(), f"{r.choice(['DB', 'MYSQL', 'ADMIN', 'SMTP', 'FTP'])}_{r.choice(['PASS', 'PWD', 'PASSWD', 'SECRET'])}={quote(r.choice([short, lambda: mixed(r.randint(8, 24))])())}", plain()),
    }
    false = {
        "digest": lambda: (plain(), benign(), cased(hexes(r.choice([32, 40, 64]))), plain()),
        "digest_assigned": lambda: (plain(), plain(), f"{benign()}{r.choice('=:')}{quote(hexes(r.choice([32, 40])))}", plain()),
        "uuid": lambda: (plain(), plain(), "-".join([hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)]), plain()),
        "digits": lambda: (plain(), plain(), "".join(r.choices(string.digits, k=r.randint(16, 20))), plain()),
        "url": lambda: (plain(), plain(), "/".join(["https:/", plain() + ".example.com", *[r.choice(DICTIONARY) for _ in range(3)], f"{r.choice(DICTIONARY)}-{r.choice(DICTIONARY)}-{r.randint(1, 9999)}"]), plain()),
        "identifier": lambda: (plain(), plain(), "_".join(r.choice(DICTIONARY) for _ in range(4)) + str(r.randint(1, 99)), plain()),
        "word_digit": lambda: (plain(), plain(), plain() + plain() + plain() + plain() + plain() + str(r.randint(1, 9)) + plain(), plain()),
        "placeholder": lambda: (name(), "=", quote(r.choice(["your-api-key-goes-here-1", "xxxxxxxxxxxxxxxxxxxx1", "example-example-example-1", "00000000000000000000", "1234567890123456", "test-user-password-123"])), plain()),
        "bare_hex": lambda: (plain(), plain(), cased(hexes(r.choice([32, 40]))), plain()),
        "long_word": lambda: (plain(), plain(), r.choice([str, str.capitalize])("".join(plain() for _ in range(r.randint(5, 8)))) + r.choice(["", ",", "."]), plain()),
        "long_capitals": lambda: (plain(), plain(), "".join(plain() for _ in range(8)).upper(), plain()),
        "heading": lambda: (plain(), plain(), heading(), plain()),
        "headings": lambda: (plain(), plain(), heading(), heading()),
        "heading_title": lambda: (plain(), plain(), heading().capitalize() + r.choice(["", ",", "."]), plain()),
        "heading_lower": lambda: (plain(), plain(), heading().lower() + r.choice(["", ",", "."]), plain()),
        "camel": lambda: (plain(), plain(), "".join(plain().capitalize() for _ in range(7)), plain()),
        "joined": lambda: (plain(), plain(), r.choice("-_/").join(word() for _ in range(r.randint(5, 7))), plain()),
        "rule": lambda: (plain(), plain(), r.choice("-_/+") * r.randint(16, 60), plain()),
        "key_names": lambda: (plain(), plain(), r.choice(["aws_secret_access_key", "my_client_secret_token", "default_auth_token_name", "user_password_reset_form"]) + r.choice(["", "="]), plain()),
        "named_word": lambda: (plain(), name() + ":", word(), plain()),
        "spaced_word": lambda: (name(), r.choice("=:"), word(), plain()),
        "bearer_word": lambda: (plain(), r.choice(["bearer", "Bearer"]), word(), plain()),
        "sk_word": lambda: (plain(), plain(), "sk-" + word(), plain()),
        "code": lambda: (name(), "=", r.choice(["None", "null", "true", "required", '"${PASSWORD}"', "<token>", "{{secret}}", "********", "os.environ[", "getenv(", "config.password", "str,", "self.token"]), plain()),
        "prose_word": lambda: (r.choice(["password", "passphrase", "token", "secret", "pass", "credentials"]), r.choice(MEANS[:3]), r.choice([word, lambda: r.choice(["required", "stored", "wrong", "not", "the", "a", "missing", "invalid", "expired", "empty", "open", "closed"])])() + r.choice(["", ".", ","]), plain()),
        "login_word": lambda: (plain(), plain(), f"{scheme()}://{r.choice(['user', 'username', 'anonymous', '$USER', '<user>'])}:{r.choice(['password', 'pass', '$PASSWORD', '${DB_PASS}', '<password>', 'anonymous', '****', '%s', '{pwd}', 'secret'])}@{host()}", plain()),
        "hook_page": lambda: (plain(), plain(), f"https://{host()}/{r.choice(['docs/webhooks', 'hooks', 'guide/hooks'])}/{'/'.join('-'.join(word() for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3)))}", plain()),
        "port": lambda: (plain(), plain(), f"http://{host()}:{r.randint(80, 9999)}/{'/'.join(word() for _ in range(r.randint(3, 5)))}", plain()),
        "pass_word": lambda: (plain(), plain(), f"{r.choice(['PASS', 'pass', 'test_pass', 'PASS'])}{r.choice('=:')}{r.choice([word, lambda: str(r.randint(0, 999)), lambda: r.choice(['true', 'false', 'yes', 'no'])])()}", plain()),
        "prefix_word": lambda: (plain(), plain(), r.choice(["npm_", "sk-", "eyJ", "xoxb-", "glpat-"]) + r.choice([word, lambda: "_".join(word() for _ in range(3)), lambda: "-".join(word() for _ in range(3)), lambda: "your-token", lambda: "xxxxxxxxxxxx-xxxxxxxxxxxx"])(), plain()),
    }
    made = {1: found, 0: false}
    rows = []
    for i in range(n):
        family = r.choice(list(made[i % 2]))
        rows.append((*made[i % 2][family](), i % 2, family))
    return spark.createDataFrame(rows, "before_2 string, before_1 string, word string, after string, label int, family string")


def by_family(labelled: DataFrame, words: tuple[str, ...] = tuple(DICTIONARY), folds: int = 6, least: float = 0.5) -> DataFrame:
    """family, label, n and taken (findings taken for secrets) of labelled findings with a family, each scored by a forest that saw none of its family.

    Families are dealt to folds by hash; a null family is one of its own. An empty table gives no rows.
    """
    fold = F.pmod(F.xxhash64(F.coalesce("family", F.lit(""))), F.lit(folds))
    text = F.concat_ws(" ", *[F.coalesce(k, F.lit("")) for k in ("before_2", "before_1", "word", "after")])
    parts = []
    for k in range(folds):
        forest = fit(labelled.where(fold != k), words)
        parts.append(labelled.where(fold == k).select("family", "label", (F.size(scan(text, forest, least)) > 0).cast("long").alias("t")))
    return functools.reduce(DataFrame.unionAll, parts).groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("t").alias("taken"))


FINDING = ["run", "word_no", "score"]


def scan(text: Column, forest: Forest, least: float = 0.5) -> Column:
    """array<struct<run, word_no, score>>: the candidates of a text that the forest takes for secrets."""
    scored = F.transform(candidates(text), lambda c: F.struct(c["run"].alias("run"), c["word_no"].alias("word_no"), forest.score(c).alias("score")))
    return F.filter(scored, lambda x: x["score"] >= least)


def findings(docs: DataFrame, forest: Forest, text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per secret: doc_id, run (the secret), word_no (its word's place in the text) and score."""
    return docs.select("doc_id", F.inline(scan(F.col(text), forest, least)))


def redact(docs: DataFrame, forest: Forest, text: str = "text", least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret of a text replaced by `mark`, longer ones first; those under 16 characters not inside other words."""
    runs = F.transform(scan(F.col(text), forest, least), lambda x: x["run"])
    longest = F.array_sort(F.array_distinct(runs), lambda a, b: F.length(b) - F.length(a))
    literal = lambda x: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    put = mark.replace("\\", r"\\").replace("$", r"\$")
    new = F.aggregate(longest, F.col(text), lambda t, x: F.when(F.length(x) >= 16, F.replace(t, x, F.lit(mark))).otherwise(F.regexp_replace(t, literal(x), F.lit(put))))
    return docs.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """Findings by digest: the secrets themselves stay out of results."""
    found = findings(docs.select("doc_id", "text"), fit(example_findings(docs.sparkSession), dictionary(docs)))
    return found.select("doc_id", "word_no", F.length("run").cast("long").alias("secret_chars"), F.sha2(F.encode("run", "UTF-8"), 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
