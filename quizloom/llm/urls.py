"""URL filters: rules first, else a logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from labelled_urls(), a table of fixed size that is built from the word lists in this file;
its weights are whole millionths, so scores are sums of integers and equal on every engine. A score above 0 blocks. Judging uses DataFrame expressions only and needs no exchange.

Contract of the cases: a null url or one without :// has an empty host and path; no rule fits it, and the model judges the
empty string; urls of any length are judged whole; repeated rows give repeated rows; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Words of sites to be blocked, a kind a line.
BAD_WORDS = """
casino poker bets betting slots jackpot roulette bingo sportsbet wager spins bonus win winner vegas blackjack odds lottery lucky
pills viagra cialis pharmacy meds drugstore steroids weightloss diet miracle cheap discount buy order online noprescription
adult xxx porn sex nude cams escort hookup dating tube hardcore erotic hot girls webcam x
ads adclick popup popunder tracker track banner clicks redirect affiliate sponsor promo traffic pixel spam farm links backlinks seo
warez crack keygen torrent serial nulled pirated cracked hacked leaked download
phish verify account-alert secure-login password-reset gift-card giveaway prize claim free survey reward
payday loan loans cash crypto doubler bitcoin-double forex rich quick replica rolex fake malware virus setup-exe
""".strip().splitlines()
#: Words of sites to be allowed, a kind a line; some hold words of the other list.
GOOD_WORDS = """
library books archive reading pillow alphabet window poetry novel journal press review essay author
museum gallery art painting theatre orchestra concert opera dance film photo sculpture
weather climate forecast mountain river garden farmers plants birds ocean forest caterpillar
school university courses lectures students campus academy science physics chemistry biology algebra
recipes kitchen soup bread cooking dinner tea coffee bakery cheese cuisine apples
news daily times herald world city council gov statistics census elections parliament budget
travel railway timetable airport maps roads bridges middlesex hotel harbour island camping
health hospital clinic nurses medicine dentist vision nutrition sleep therapy yoga fitness
software docs project forum developers uploads threads python linux compiler database kernel
music football cricket tennis chess cycling running swimming league stadium coaching
""".strip().splitlines()
#: Where hosts begin and end, and paths of each kind of site.
STARTS = ["", "www.", "m.", "blog.", "shop.", "static."]
ENDS = ["example.com", "example.net", "example.org", "com", "net", "org", "info", "co.uk", "de", "fr"]
PATHS = ["/en/1234", "/de/5678.html", "/fr/91011/", "/es/2345", "/", "", "/articles/2020/05/title", "/about", "/wiki/Page_name", "/posts/how-to-read", "/index.html", "/catalog/item/77"]
BAD_PATHS = ["/free-bonus/win", "/buy/cheap", "/click/redirect.php", "/download/setup.exe", "/xxx/videos", "/claim/prize", "/login/verify.php", "/promo/track"]


#: Syllables of names that mean nothing, which are allowed like any name that is not known to be bad.
SYLLABLES = "an bel cor dan el fer gor hin is jor kel lan mor nes or pel quin ros sen tal un ver wen yor zan ter ing ment ous ria lo shi".split()


def labelled_urls() -> list[tuple[int, str, str]]:
    """(1 to be blocked or 0, host, path): names of two words of one kind, each under VARIANTS hosts and paths.

    Two of three urls to be blocked have a path that any site may have, so hosts and paths must tell by themselves.
    """
    names = []
    for label, kinds in ((1, BAD_WORDS), (0, GOOD_WORDS)):
        for words in map(str.split, kinds):
            pairs = [(i, step) for step in (1, 2, 4) for i in range(len(words))]
            names += [(label, words[i] + ("-" if (i + step) % 3 else "") + words[(i + step) % len(words)]) for i, step in pairs]
            names += [(label, word) for word in words if label == 0]
    n = len(SYLLABLES)
    names += [(0, SYLLABLES[i % n] + ("-" if i % 5 == 0 else "") + SYLLABLES[i * 7 // 3 % n] + SYLLABLES[i * 11 // 4 % n] * (i % 2)) for i in range(NONSENSE)]
    out = []
    for label, name in names:
        for _ in range(VARIANTS):
            # a fixed scramble: starts, ends and paths have nothing to do with the name
            k = int(hashlib.md5(f"{len(out)}".encode()).hexdigest()[:12], 16)
            bad_path = label == 1 and len(out) % 3 == 0
            path = BAD_PATHS[k % len(BAD_PATHS)] if bad_path else PATHS[k % len(PATHS)]
            out.append((label, STARTS[k // 97 % len(STARTS)] + name + "." + ENDS[k // 1009 % len(ENDS)], path))
    return out


#: Hosts and paths for each name, and names of syllables.
VARIANTS, NONSENSE = 3, 250
#: Sizes of the n-grams, the buckets they are hashed into, and how the regression is fitted; BAD_SHARE is the weight of all
#: urls to be blocked together.
GRAMS, BUCKETS, EPOCHS, RATE, DECAY, SCALE, BAD_SHARE = (3, 5), 16384, 2500, 0.1, 2e-4, 1_000_000, 0.5


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % BUCKETS


def buckets_of(host: str, path: str) -> list[int]:
    """The buckets of a url's n-grams; host and path are marked, so each has its own, and all digits count as 0."""
    texts = [(mark, re.sub("[0-9]", "0", f"^{text}$")) for mark, text in (("h", host), ("p", path))]
    return [_bucket(mark + text[i : i + n]) for mark, text in texts for n in GRAMS for i in range(len(text) - n + 1)]


def fit(rows: list[tuple[int, str, str]] | None = None) -> tuple[int, list[int]]:
    """The bias and the weight of each bucket in millionths: full-batch gradient descent on n-gram counts."""
    rows = labelled_urls() if rows is None else rows
    found = [buckets_of(host, path) for _, host, path in rows]
    row, at = np.repeat(np.arange(len(rows)), [len(x) for x in found]), np.concatenate(found)
    label = np.array([x[0] for x in rows], dtype=float)
    share = np.where(label == 1, BAD_SHARE / label.sum(), (1 - BAD_SHARE) / (len(label) - label.sum()))
    bias, weights = 0.0, np.zeros(BUCKETS)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights[at], len(rows)))))
        off = share * (p - label)
        bias -= RATE * off.sum()
        weights -= RATE * (np.bincount(at, off[row], BUCKETS) + DECAY * weights)
    return round(bias * SCALE), [round(w * SCALE) for w in weights.tolist()]


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (bias and n-grams' weights in millionths)."""
    bias, weights = fit()
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    # characters as arrays: a substring of a long text would be sought from its beginning
    chars = lambda part: F.regexp_extract_all(F.concat(F.lit("^"), F.translate(part, "123456789", "000000000"), F.lit("$")), F.lit("(?s)."), F.lit(0))
    out = out.select("*", chars("host").alias("_h"), chars("path").alias("_p"))

    def sum_of(mark: str, n: int) -> Column:
        """The weights of a text's n-grams, added up."""
        text = F.col(f"_{mark}")
        starts = F.when(F.size(text) >= n, F.sequence(F.lit(1), F.size(text) - (n - 1))).otherwise(F.array().cast("array<int>"))

        def weight(i: Column) -> Column:
            code = F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.array_join(F.slice(text, i, F.lit(n)), "")).cast("binary")), 1, 7), 16, 10).cast("bigint")
            return F.element_at(table, (F.pmod(code, F.lit(BUCKETS)) + 1).cast("int"))

        return F.aggregate(F.transform(starts, weight), F.lit(0).cast("bigint"), lambda a, w: a + w)

    score = F.lit(bias).cast("bigint")
    for mark in "hp":
        for n in GRAMS:
            score = score + sum_of(mark, n)
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    out = out.withColumns({"rule": rule, "_ruled": verdict, "score": score})
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def judge_sql() -> str:
    """judge over the view pages, for DuckDB."""
    bias, weights = fit()
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for c, (_, h, p) in zip(fits, ordered)) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{kind}'" for c, (kind, _, _) in zip(fits, ordered)) + " END"
    sums = [
        f"coalesce(CAST(list_sum(list_transform(range(1, length({part}) + 4 - {n}), lambda i: w[(('0x' || substr(md5('{mark}' || substr('^' || translate({part}, '123456789', '000000000') || '$', i, {n})), 1, 7))::BIGINT % {BUCKETS}) + 1])) AS BIGINT), 0)"
        for mark, part in (("h", "host"), ("p", "path")) for n in GRAMS
    ]
    total = " + ".join(sums)
    return f"""
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
weights AS (SELECT {weights}::BIGINT[] AS w),
scored AS (SELECT page_id, host, path, ({bias}) + {total} AS score FROM split, weights)
SELECT page_id, host, path, {rule} AS rule, coalesce({ruled}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, CAST(score AS BIGINT) AS score
FROM scored"""
