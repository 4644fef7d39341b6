"""URL filters: pattern rules indexed by their rarest literal token.

A rule allows or blocks a host with all its subdomains, or what lies below a path there:
`example.net/en/`. `*` in a host stands for one label, in a path for any characters. A rule's
literal tokens are its whole host labels and whole path segments. Each rule is kept under the one
of them that is rarest in the URLs at hand; a URL's own tokens fetch the rules kept under them,
and only those rules' regular expressions run. Rules without a literal token are tried on all.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no rule.
Of the rules that fit, the longest wins, among equally long ones the earliest. Repeated rows each
get a result; other columns stay as they are unless their names are those of the results, which
replace them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.scratch import written

RULES_BROADCAST = 2_000_000
TOKENS_AT_ONCE = 5_000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str  # host, then the path from its first /

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""

    def tokens(self) -> set[str]:
        """Literal tokens that any URL that fits has too."""
        whole = self.path.split("/")[1:-1]  # the last segment may go on in the URL
        return {t for t in [*self.host.split("."), *whole] if t and "*" not in t}

    def pattern(self) -> str:
        """Over the host, a # (which neither can hold) and the path."""
        host = r"[^.#]*".join(map(re.escape, self.host.split("*")))
        path = "[^#]*".join(map(re.escape, self.path.split("*")))
        return rf"(?:[^#]*\.)?{host}\#{path}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    a_z = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(host, F.lit("")), a_z.upper(), a_z), F.coalesce(path, F.lit(""))


def url_tokens(host: str, path: str) -> set[str]:
    return {*host.split("."), *path.split("/")[1:]}


def index(rules: list[Rule], frequency: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Each rule's number under its rarest token; the numbers of those that have none."""
    by_token: dict[str, list[int]] = defaultdict(list)
    always = []
    for k, rule in enumerate(rules):
        if tokens := rule.tokens():
            by_token[min(tokens, key=lambda t: (frequency.get(t, 0), t))].append(k)
        else:
            always.append(k)
    return dict(by_token), always


def token_frequency(hosts: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules is found, over all of hosts (host, path)."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    found = hosts.select(F.explode(F.array_distinct(F.concat(F.split("host", r"\."), F.split("path", "/")))).alias("token"))
    out: dict[str, int] = {}
    for k in range(0, len(wanted), TOKENS_AT_ONCE):
        part = found.where(F.col("token").isin(wanted[k : k + TOKENS_AT_ONCE]))
        out |= {r["token"]: r["count"] for r in part.groupBy("token").count().collect()}
    return out


def _matcher(spark: SparkSession, rules: list[Rule], frequency: dict[str, int], default: str, url_at: int, kept: list[str]) -> Callable:
    """The function over Arrow batches whose last columns are host, path, rule and verdict so far (a rule may have been found already)."""
    by_token, always = index(rules, frequency)
    shared = spark.sparkContext.broadcast((by_token, always, [(r.verdict, r.text, r.pattern()) for r in rules]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token, always, known = shared.value
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            *_, hosts, paths, rule, verdict = (batch.column(k).to_pylist() if k >= url_at else None for k in range(batch.num_columns))
            for i, (host, path) in enumerate(zip(hosts, paths)):
                if not host:
                    continue
                tried = {k for t in url_tokens(host, path) if t in by_token for k in by_token[t]}
                for k in sorted(tried.union(always), key=lambda k: (-len(known[k][1]), k)):
                    if rule[i] is not None and len(rule[i]) >= len(known[k][1]):
                        break  # an earlier block's rule is as long
                    if (p := compiled.get(k)) is None:
                        p = compiled[k] = re.compile(known[k][2])
                    if p.match(f"{host}#{path}"):
                        rule[i], verdict[i] = known[k][1], known[k][0]
                        break
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*kept, "host", "path", "rule", "verdict"])

    return judge


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", rules_at_once: int = RULES_BROADCAST) -> DataFrame:
    """pages with host, path, rule (the winning rule's text, else null) and verdict (else `default`).

    Narrow: the rules are broadcast, rules_at_once at most; more rules go in several passes, whose
    results are written in between. Nothing is shuffled but the counts of the rules' own tokens.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = pages.select(*kept, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    schema = StructType([*out.schema.fields[:-1], StructField("verdict", StringType())])
    frequency = token_frequency(out.select("host", "path"), rules)
    for k in range(0, max(1, len(rules)), rules_at_once):
        if k:
            out = written(out, "urls")
        out = out.mapInArrow(_matcher(spark, rules[k : k + rules_at_once], frequency, default, len(kept), kept), schema)
    return out
