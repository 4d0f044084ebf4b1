"""Personal data: generators with high recall, boosted trees over their candidates, thresholds per generator.

The four base kinds are patterns with fixed checks and are always kept.  Six more generators propose
spans that may overlap (long numbers, national phone numbers, key-like tokens, odd e-mail addresses,
account numbers, national ids); trees score each candidate from its format and the words before it, and a
threshold per generator, set for its precision on labelled rows the trees have not seen, decides.  Of
overlapping candidates the likelier stays; one goes only where it overlaps one that stays, and none
overlaps a base span.  Candidates are swept by place in runs of overlapping ones, so time grows with a
text's candidates, not with their pairs.

The trees are fitted on the driver to a fixed number of generated, labelled snippets
(``TRAINING_ROWS``), whose features the same Spark expressions compute, and become one Spark expression:
finding and redacting run DataFrame functions only.

Contract: a null text is an empty one; texts are read whole; places are code points, ends exclusive;
equal texts have equal spans, repeated rows are searched each; of equal odds the earlier span, then the
earlier generator, stays; an empty table gives no rows; redaction leaves other columns as they are.
"""

from __future__ import annotations

import json
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("number", "phone_local", "secret", "email_odd", "iban", "national_id")
#: Possessive, and begun only where a longer match to the left is impossible: time stays linear on any text, matches are the plain patterns'.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"(?<![0-9])[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
LOCAL = r"(?<![0-9+])\(?0?[1-9][0-9]{1,3}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"
ODD_EMAIL = r"(?<![^\s@])[^\s@]++@[^\s@]++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Digits in threes, twos and fours; letters around six digits; eight digits and a letter; fifteen digits that begin with sex, year and month.
NATIONAL = r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]|[0-9]{8}-?[A-HJ-NP-TV-Z]|[12] ?[0-9]{2} ?[01][0-9] ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2})(?![A-Za-z0-9-])"
#: Heads of keys that services give out.
VENDOR = r"^(?:[sprw]k[_-](?:live|test|proj)|sk-|xox[a-z]-|gh[a-z]_|github_pat_|glpat-|AKIA|ASIA|AIza|npm_|hf_|pypi-|ya29|dop_v1_|shp[a-z]{2}_|SG[_-])"
#: Words looked for in the CONTEXT characters before a candidate.
CONTEXT = 24
CUES = (
    r"(?i)phone|tel|call|mobile|fax|whatsapp|reach",
    r"(?i)key|token|secret|passw|pwd|api|auth|credential|bearer",
    r"(?i)card|account|iban|visa|payment|customer|ssn|passport|social|national|insurance|dni|tax",
    r"(?i)mail|contact|write to|address",
    r"(?i)order|invoice|version|build|isbn|page|item|total|price|id\b|sku|chapter|commit|sha|ticket|doi\b|arxiv|version|serial",
)
FEATURES = ("generator", "length", "digits", "letters", "capitals", "separators", "turns", "luhn", "assigned", "glued", "grouped", "vendor", "mod97", "dotted", *(f"cue{k}" for k in range(len(CUES))))
TRAINING_ROWS, TREES, DEPTH, RATE, PRECISION, SEED = 4800, 40, 4, 0.3, 0.97, 7

GENERATED = ("_digits", "_local", "_secret", "_odd", "_iban", "_national")
_NONE = "cast(array() as array<struct<start:int,end:int,s:string,before:string,after:string>>)"


def found(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, end, s, before, after>>: the pattern's matches, leftmost and not overlapping, with their places, what
    stands before (the match before and what lies between, CONTEXT characters at most) and the next character. gate: false only where there is none.

    Context comes from the parts between matches: finding a place in a text anew for each match would take quadratic time.
    """
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(matches)
    inner = F.zip_with(F.slice(between, 1, n), matches, lambda gap, s: F.struct(gap.alias("gap"), s.alias("s")))
    outer = F.zip_with(F.slice(F.concat(F.array(F.lit("")), matches), 1, n), F.slice(between, 2, n), lambda last, gap: F.struct(last.alias("last"), F.substring(gap, 1, 1).alias("after")))
    pairs = F.zip_with(inner, outer, lambda i, o: F.struct(i["gap"].alias("gap"), i["s"].alias("s"), F.right(F.concat(o["last"], i["gap"]), F.lit(CONTEXT)).alias("before"), o["after"].alias("after")))
    # numbers alone are gathered in the running sum: Spark copies what is gathered at every step
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["gap"]) + F.length(x["s"])).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(x["gap"])).alias("out"))
    begins = F.aggregate(pairs, none, step, lambda acc: acc["out"])
    made = F.zip_with(begins, pairs, lambda at, x: F.struct(at.alias("start"), (at + F.length(x["s"])).alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))
    return F.when(gate, made).otherwise(F.expr(_NONE))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base spans (_email, _ip, _card, _phone) and what the other generators propose (_candidates)."""
    t = F.col(text)
    df = df.withColumn("_digit", t.rlike("[0-9]"))  # most generators need one: texts without pass them by
    some = F.col("_digit")
    df = df.withColumns(
        {
            "_email": found(t, EMAIL, F.contains(t, F.lit("@"))),
            "_ip": F.filter(found(t, IP, some & t.rlike(r"[0-9]\.[0-9]")), lambda x: x["s"].rlike(IP_PARTS)),
            "_digits": F.filter(found(t, DIGITS, some & t.rlike(r"[0-9](?:[ -]?[0-9]){6}")), lambda x: F.length(only_digits(x["s"])) >= 7),
            "_phone": F.filter(found(t, PHONE, some & F.contains(t, F.lit("+"))), lambda x: F.length(only_digits(x["s"])).between(9, 15)),
            "_local": found(t, LOCAL, some & t.rlike(r"[0-9]{3,4}[ ./-][0-9]{3,4}")),
            "_secret": found(t, SECRET, some & t.rlike(SECRET)),
            "_odd": found(t, ODD_EMAIL, F.contains(t, F.lit("@"))),
            "_iban": found(t, IBAN, some & t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")),
            "_national": found(t, NATIONAL, some & t.rlike(r"[0-9]{3}-[0-9]{2}-|[0-9]{8}-?[A-Z]|[0-9]{2} ?[A-D]|[12] ?[0-9]{2} ?[01][0-9] ?[0-9]{2} ?[0-9]{3}")),
        }
    )
    df = df.withColumn("_card", F.filter("_digits", lambda x: F.length(only_digits(x["s"])).between(13, 19) & F.call_function("luhn_check", only_digits(x["s"]))))
    # lambdas of Spark take an index as a second parameter, so the number comes from an outer function
    numbered = lambda c, g: F.transform(c, lambda x: F.struct(F.lit(g).alias("g"), x["start"].alias("start"), x["end"].alias("end"), features(x, g).alias("f")))
    return df.withColumn("_candidates", F.concat(*[numbered(c, g) for g, c in enumerate(GENERATED)])).drop(*GENERATED, "_digit")


def features(x: Column, g: int) -> Column:
    """array<double> in the order of FEATURES."""
    s = x["s"]
    count = lambda pattern: F.length(s) - F.length(F.regexp_replace(s, pattern, ""))
    before, after = x["before"], x["after"]
    values = [
        g,
        F.length(s),
        count("[0-9]"),
        count("[A-Za-z]"),
        count("[A-Z]"),
        count("[ ()./-]"),
        F.size(F.regexp_extract_all(s, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0))),
        F.coalesce(F.call_function("luhn_check", only_digits(s)), F.lit(False)),
        before.rlike(r"[=:\"'] ?$|[=:] ?[\"']$"),
        before.rlike(r"[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"),
        s.rlike(r"^\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,4}){2,4}$"),
        s.rlike(VENDOR) if MORE_KINDS[g] == "secret" else 0,
        mod97(s) if MORE_KINDS[g] == "iban" else 0,
        s.rlike(r"^[^@]+@[^@.]+(?:\.[^@.]+)*\.[A-Za-z]{2,}[.,;:)]?$") if MORE_KINDS[g] == "email_odd" else 0,
        *(before.rlike(c) for c in CUES),
    ]
    return F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("double") for v in values])


def mod97(s: Column) -> Column:
    """Whether an account number's check digits fit: its first four places last, letters as 10 to 35, leave 1 over 97."""
    plain = F.regexp_replace(s, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    # a digit moves the number by one place, a letter by two
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)
    return F.aggregate(turned, F.lit(0), step) == 1


def snippets(n: int = TRAINING_ROWS, seed: int = SEED) -> list[tuple[str, int]]:
    """Labelled snippets, one planted string each: (text, 1 if it is personal data)."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "re", "the", "sch", "ing", "or", "la", "mi", "to", "ed", "os"]) for _ in range(r.randint(1, 4)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    token = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("ABCDEGHJKLMNPRSTWXYZ") for _ in range(k))
    spread = lambda x: " ".join(x[k : k + 4] for k in range(0, len(x), 4)) if r.random() < 0.5 else x
    accented = lambda: "".join(r.choice(["ü", "ö", "é", "ñ", "ç", "ø", "an", "re", "jo", "mi", "la"]) for _ in range(r.randint(2, 4))) + r.choice("üöéñ")
    key_cue = lambda: r.choice(["api_key = \"", "token: ", "token = \"", "secret=", "secret: ", "password=", "key=", "auth: ", "key ", "token ", "api key ", "key token ", "bearer ", "secret is "])

    def iban(good: bool) -> str:
        body, country = digits(r.choice([14, 16, 18, 20])), r.choice(["DE", "FR", "ES", "GB", "NL"])
        if country == "GB":
            body = letters(4) + body
        over = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return spread(country + f"{98 - over if good else (99 - over) % 97:02d}" + body)

    yes = [
        lambda: (r.choice(["call ", "tel: ", "phone ", "mobile ", "fax ", ""]), f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: (r.choice(["call ", "tel: ", "phone number ", "reach me on "]), f"0{r.randint(10, 99)} {digits(3)} {digits(4)}"),
        lambda: (r.choice(["account ", "card ", "ssn ", "customer ", "account number ", "passport ", "card no. "]), digits(r.choice([9, 10, 12, 16]))),
        lambda: (r.choice(["ssn ", "social security ", "ssn: ", ""]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (r.choice(["national insurance ", "insurance number ", ""]), f"{r.choice(['AB', 'JK', 'TW', 'PC'])} {digits(2)} {digits(2)} {digits(2)} {r.choice('ABCD')}"),
        lambda: (r.choice(["dni ", "national id ", "tax id "]), digits(8) + r.choice(["", "-"]) + r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")),
        lambda: (r.choice(["social security ", "national id ", ""]), f"{r.choice('12')} {digits(2)} {r.randint(1, 12):02d} {digits(2)} {digits(3)} {digits(3)} {digits(2)}"),
        lambda: (key_cue(), r.choice([hexa(32), hexa(40), hexa(64), token(24), token(40)])),
        lambda: (key_cue(), r.choice([hexa(32), hexa(40), token(32)])),
        lambda: ("", r.choice(["AKIA" + token(16).upper(), "ghp_" + token(36), "xoxb-" + digits(10) + "-" + token(10), "sk_live_" + token(24), "sk-" + token(40), "glpat-" + token(20), "AIza" + token(35), "hf_" + token(34)])),
        lambda: (r.choice(["key ", "token ", "secret: ", ""]), r.choice(["ghp_" + token(36), "xoxb-" + digits(10) + "-" + token(10).lower(), "xoxp-" + digits(12) + "-" + digits(12) + "-" + token(24)])),
        lambda: (r.choice(["mail ", "contact ", "write to ", ""]), f"{word()}.{word()}@{word()}ö.de"),
        lambda: (r.choice(["mail ", "contact ", ""]), f"{accented()}.{accented()}@{accented()}{word()}.{r.choice(['de', 'com', 'fr', 'org'])}"),
        lambda: (r.choice(["mail ", ""]), f"{word()}'{word()}@{word()}.{r.choice(['de', 'com', 'org'])}"),
        lambda: (r.choice(["iban ", "account ", "IBAN: ", ""]), iban(True)),
        lambda: ("", iban(True)),
    ]
    no = [
        lambda: (r.choice(["order ", "invoice ", "item ", "page ", "isbn ", "serial "]), digits(r.choice([7, 8, 10, 13]))),
        lambda: (r.choice(["total ", "price ", "of "]), f"{digits(3)}.{digits(3)}.{digits(3)}"),
        lambda: (r.choice(["on ", "since ", ""]), f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
        lambda: (r.choice(["build ", "version ", "commit ", "sha "]), hexa(r.choice([20, 40]))),
        lambda: (r.choice(["build ", "commit ", "sha256 ", "md5 sha "]), hexa(r.choice([32, 40, 64]))),
        lambda: ("", f"{word()}-{word()}-{word()}-{word()}-{r.randint(1, 99)}"),
        lambda: (r.choice(["sku ", "id "]), f"{token(4).upper()}-{digits(4)}-{digits(8)}"),
        lambda: ("", digits(r.choice([7, 8, 20, 25]))),
        lambda: ("", digits(r.choice([9, 10, 11, 12, 13, 14, 15, 16, 16, 19]))),
        lambda: ("", digits(r.choice([9, 12, 16, 16]))),
        lambda: (r.choice(["doi ", "doi: ", "arxiv ", "see doi "]), f"10.{digits(4)}/{word()}.{digits(9)}"),
        lambda: (r.choice(["see ", ""]), f"{word()}@" + word() if r.random() < 0.5 else f"@{word()}@{word()}"),
        lambda: (r.choice(["see ", ""]), f"{accented()}@{accented()}"),
        lambda: (r.choice(["ticket ", "chapter "]), f"{digits(3)} {digits(3)} {digits(3)}"),
        lambda: (r.choice(["ticket ", "serial ", ""]), iban(False)),
        lambda: (r.choice(["order ", "item ", "sku "]), digits(8) + "-" + r.choice("ABCDEF")),
    ]
    out = []
    for k in range(n):
        label = k % 2
        cue, what = r.choice(yes if label else no)()
        head = " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((f"{head} {cue}{what}{r.choice([' ', '.', ', ', chr(34) + ' '])}{word()}", label))
    return out


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int) -> tuple | float:
    """A regression tree on second-order sums: (feature, threshold, at most, above), leaves are values."""
    value = float(gradient.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return value
    whole, best = gradient.sum() ** 2 / (weight.sum() + 1.0), (1e-6, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, w = x[order, j], np.cumsum(gradient[order]), np.cumsum(weight[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            gain = g[at] ** 2 / (w[at] + 1.0) + (g[-1] - g[at]) ** 2 / (w[-1] - w[at] + 1.0) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
    _, j, threshold = best
    if j < 0:
        return value
    low = x[:, j] <= threshold
    return j, threshold, grow(x[low], gradient[low], weight[low], depth - 1), grow(x[~low], gradient[~low], weight[~low], depth - 1)


def value(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, threshold, low, high = tree
    return np.where(x[:, j] <= threshold, value(low, x), value(high, x))


def tree_column(tree: tuple | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    j, threshold, low, high = tree
    return F.when(F.get(f, F.lit(j)) <= threshold, tree_column(low, f)).otherwise(tree_column(high, f))


class Model:
    """Trees whose sum is a log-odds, and the least log-odds accepted for each generator."""

    def __init__(self, trees: list, least: list[float]):
        self.trees, self.least = trees, least

    def odds(self, f: Column) -> Column:
        return reduce(lambda a, b: a + b, [tree_column(t, f) * RATE for t in self.trees])

    def accepted(self, c: Column, odds: Column) -> Column:
        bound = F.lit(float("inf"))
        for g, x in enumerate(self.least):
            bound = F.when(c["g"] == g, x).otherwise(bound)
        return odds >= bound


_MODELS: dict[tuple, Model] = {}


def trained(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> Model:
    """The model fitted to the generated snippets; a third of them set the thresholds."""
    if (rows, seed) in _MODELS:
        return _MODELS[rows, seed]
    given = json.dumps([{"n": k, "text": t, "label": y} for k, (t, y) in enumerate(snippets(rows, seed))])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(given), "array<struct<n:int,text:string,label:int>>")).alias("x")).select("x.*")
    sought = with_candidates(table).withColumn("_base", F.concat(*[f"_{k}" for k in BASE_KINDS]))
    free = F.filter("_candidates", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    got = sought.select("n", "label", F.explode(free).alias("c")).select("n", "label", "c.f").orderBy("n", "f").collect()
    x, y, part = np.array([r["f"] for r in got], float), np.array([r["label"] for r in got], float), np.array([r["n"] // 2 % 3 for r in got])
    fit, odds, trees = part != 0, np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        trees.append(grow(x[fit], (y - p)[fit], (p * (1 - p))[fit], DEPTH))
        odds += RATE * value(trees[-1], x)
    least = []
    for g in range(len(MORE_KINDS)):
        mine = (x[:, 0] == g) & ~fit
        order = np.argsort(-odds[mine], kind="stable")
        o, hits = odds[mine][order], y[mine][order]
        good = np.flatnonzero(np.cumsum(hits) / np.arange(1, len(hits) + 1) >= PRECISION)
        # at the lowest odds whose rows, all of equal odds included, keep the precision
        good = [k for k in good if k + 1 == len(o) or o[k + 1] < o[k]]
        least.append(float(o[good[-1]]) if good else float("inf"))
    _MODELS[rows, seed] = Model(trees, least)
    return _MODELS[rows, seed]


_KEPT = "array<struct<start:int,g:int,end:int>>"


def _flags(run: Column) -> Column:
    """For each of a run, array<struct<start, g, end, odds, i>>, whether a pass by falling odds, then start and g, keeps it: base spans (g below 0), and what overlaps none kept before."""
    fall = F.array_sort(F.transform(run, lambda c: F.struct(F.when(c["g"] < 0, float("-inf")).otherwise(-c["odds"]).alias("cost"), c["start"].alias("start"), c["g"].alias("g"), c["end"].alias("end"), c["i"].alias("i"))))
    taken = lambda kept, c: F.exists(kept, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))
    step = lambda kept, c: F.when((c["g"] < 0) | ~taken(kept, c), F.array_append(kept, c)).otherwise(kept)
    kept = F.aggregate(fall, F.expr("cast(array() as array<struct<cost:double,start:int,g:int,end:int,i:int>>)"), step, lambda acc: F.transform(acc, lambda c: c["i"]))
    # an array of one holds the list, which is then made once and not for each element
    many = F.element_at(F.transform(F.array(kept), lambda ids: F.transform(run, lambda c: F.array_contains(ids, c["i"]))), 1)
    return F.when(F.size(run) == 1, F.array(F.lit(True))).when(F.size(run) == 0, F.expr("cast(array() as array<boolean>)")).otherwise(many)


def without_overlaps(scored: Column) -> Column:
    """Of array<struct<g, start, end, odds>> those, by start, that are kept: a pass by falling odds, in each run of overlapping ones apart."""
    ordered = F.array_sort(F.transform(scored, lambda c: F.struct(c["start"].alias("start"), c["g"].alias("g"), c["end"].alias("end"), c["odds"].alias("odds"))))
    numbered = F.transform(ordered, lambda c, i: F.struct(c["start"].alias("start"), c["g"].alias("g"), c["end"].alias("end"), c["odds"].alias("odds"), i.alias("i")))
    none = F.struct(F.lit(0).alias("until"), F.expr("cast(array() as array<struct<start:int,g:int,end:int,odds:double,i:int>>)").alias("run"), F.expr("cast(array() as array<boolean>)").alias("flags"))

    def step(acc: Column, c: Column) -> Column:
        apart = c["start"] >= acc["until"]
        return F.struct(
            F.greatest(acc["until"], c["end"]).alias("until"),
            F.when(apart, F.array(c)).otherwise(F.array_append(acc["run"], c)).alias("run"),
            F.when(apart, F.concat(acc["flags"], _flags(acc["run"]))).otherwise(acc["flags"]).alias("flags"),
        )

    flags = F.aggregate(numbered, none, step, lambda acc: F.concat(acc["flags"], _flags(acc["run"])))
    marked = F.zip_with(ordered, flags, lambda c, keep: F.struct(c["start"].alias("start"), c["g"].alias("g"), c["end"].alias("end"), keep.alias("keep")))
    return F.transform(F.filter(marked, lambda c: c["keep"] & (c["g"] >= 0)), lambda c: F.struct(c["start"].alias("start"), c["g"].alias("g"), c["end"].alias("end")))


def with_spans(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with ``spans``: array<struct<kind, start, end>>, base kinds first, each kind by start."""
    df = with_candidates(df, text)
    kind = lambda name, c: F.transform(c, lambda x: F.struct(F.lit(name).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    df = df.withColumn("_scored", F.transform("_candidates", lambda c: F.struct(c["g"].alias("g"), c["start"].alias("start"), c["end"].alias("end"), model.odds(c["f"]).alias("odds"))))
    df = df.withColumn("_accepted", F.filter("_scored", lambda c: model.accepted(c, c["odds"])))
    ruled = F.transform(F.concat(*[f"_{k}" for k in BASE_KINDS]), lambda b: F.struct(F.lit(-1).alias("g"), b["start"].alias("start"), b["end"].alias("end"), F.lit(0.0).alias("odds")))
    df = df.withColumn("_kept", F.when(F.size("_accepted") > 0, without_overlaps(F.concat(ruled, F.col("_accepted")))).otherwise(F.expr(f"cast(array() as {_KEPT})")))
    of = lambda g: F.filter("_kept", lambda c: c["g"] == g)
    more = [kind(name, of(g)) for g, name in enumerate(MORE_KINDS)]
    return df.withColumn("spans", F.concat(*[kind(k, F.col(f"_{k}")) for k in BASE_KINDS], *more)).drop(*[f"_{k}" for k in BASE_KINDS], "_candidates", "_scored", "_accepted", "_kept")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by its kind in square brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        apart = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with personal data redacted in ``text``; ``n_chars`` follows; a null text stays null."""
    # the row travels as one struct, so no column of the input can clash with those of the search
    found_ = with_spans(docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("body")), model, "body")
    clean = found_.withColumn("clean", redacted(F.col("body"), F.col("spans")))
    changed = F.size("spans") > 0
    values = {"text": F.when(changed, F.col("clean")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return clean.select(*[values[c].alias(c) if c in values else F.col("row")[c].alias(c) for c in docs.columns])
