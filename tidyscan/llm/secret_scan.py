"""Secret scans over an incremental blob ledger.

Texts are content-addressed by SHA-256, so a version that many paths hold is one blob.  The ledger has a row for every blob
and scan: the rule versions that ran on it and the spans they found.  A scan

1. finds the blobs of all given paths, every historical version among them,
2. runs on each blob only the rule versions that the ledger lacks for it,
3. adds what it did to the ledger, and
4. joins the ledger's findings back to all paths.

The base rules are fixed; further ones add spans.  A changed rule gets a new version, and only it runs again.

Edge cases: a null text is an empty one, without findings; repeated rows are paths of the same blob and get the same findings; a
null ``doc_id`` stays; an empty table or ledger works; extra columns, whatever their names, are kept as part of the path.  Very long
texts are searched whole.  Spans that tie at one start go by the order of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, settled, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group that must be so long, and the version of both."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
]
#: Rules of the method's own.
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"),
]
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches, leftmost first and not overlapping, without those that are too short.

    What stands between the matches gives their places: the text is split by the pattern."""
    none = F.expr("cast(array() as array<struct<rule:string,start:int,end:int>>)")
    pattern, tagged = F.lit(rule.pattern), F.lit(rule.name)

    def place(m: Column) -> Column:
        step = F.transform(m["hits"], lambda h, i: F.struct(
            F.length(F.get(m["gaps"], i)).alias("gap"), F.length(h).alias("size"), F.length(F.get(m["values"], i)).alias("value")))

        def add(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            span = F.struct(tagged.alias("rule"), start.alias("start"), (start + x["size"]).alias("end"))
            found = F.when(x["value"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
            return F.struct((start + x["size"]).alias("at"), found.alias("found"))

        return F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    found = F.struct(
        hits.alias("hits"),
        (F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits).alias("values"),
        F.split(text, rule.pattern, -1).alias("gaps"),
    )
    return F.when(text.rlike(_sieve(rule)), let(found, place)).otherwise(none)


def _sieve(rule: Rule) -> str:
    """A pattern that every text with a long enough match of the rule has, and few others."""
    if rule.pattern.endswith("]+") and rule.group == 0 and rule.least > 1:
        lead = len(rule.pattern.split("[")[0])
        return f"{rule.pattern[:-1]}{{{rule.least - lead},}}"
    return rule.pattern


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """New ledger rows: blobs of ``docs`` with the rule versions not yet in the ledger, and what they found."""
    blobs = docs.select(F.sha2(text_of(), 256).alias("blob"), text_of().alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", names)
    else:
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        left = F.array_except(names, F.coalesce("done", F.expr("cast(array() as array<string>)")))
        todo = blobs.join(done, "blob", "left").withColumn("todo", left).filter(F.size("todo") > 0)
    none = F.expr("cast(array() as array<struct<rule:string,start:int,end:int>>)")
    ran = [F.when(F.array_contains("todo", r.name), spans(F.col("text"), r)).otherwise(none) if ledger is not None
           else spans(F.col("text"), r) for r in rules]
    return todo.select("blob", F.col("todo").alias("rules"), F.concat(*ran).alias("findings"))


def join_back(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Rows (row, blob, findings): every path with the findings of the given rule versions in its blob."""
    names = [r.name for r in rules]
    wanted = ledger.select("blob", F.filter("findings", lambda x: x["rule"].isin(names)).alias("findings")).filter(F.size("findings") > 0)
    # a blob has a ledger row for each scan that had something left to do
    wanted = wanted.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    paths = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.sha2(text_of(), 256).alias("blob"))
    none = F.expr("cast(array() as array<struct<rule:string,start:int,end:int>>)")
    return paths.join(wanted, "blob", "left").select("row", "blob", F.coalesce("findings", none).alias("findings"))


def scan_history(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """The findings of all paths, and the ledger to keep for the next scan."""
    fresh = scan(docs, ledger, rules)
    whole = fresh if ledger is None else ledger.unionByName(fresh)
    return join_back(docs, whole, rules), whole


def _listed(findings: Column, rules: list[Rule]) -> Column:
    """kind:start:end of the findings by start, then by the order of the rules, joined by commas."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    chosen = F.filter(findings, lambda x: x["rule"].isin([r.name for r in rules]))
    ordered = F.sort_array(F.transform(chosen, lambda x: F.struct(x["start"], rank[x["rule"]].alias("rank"), x["end"], kind[x["rule"]].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """One row for each document: numbers and digest of the base rules' spans, and all spans."""
    paths, _ = scan_history(docs.select("doc_id", "text"), ledger, rules)
    return _report(paths, rules)


def secret_scans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The same by two scans over one stored ledger: the base rules on all blobs, then of all rules only what the ledger lacks."""
    docs = docs.select("doc_id", "text")
    ledger = settled(scan(docs, None, BASE_RULES))
    whole = ledger.unionByName(settled(scan(docs, ledger, rules)))
    return _report(join_back(docs, whole, rules), rules)


def _report(paths: DataFrame, rules: list[Rule]) -> DataFrame:
    number = lambda r: F.size(F.filter("findings", lambda x: x["rule"] == r.name)).cast("long")
    return paths.select(
        "row.doc_id",
        *[number(r).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_listed(F.col("findings"), BASE_RULES), 256).alias("base_sha256"),
        _listed(F.col("findings"), rules).alias("spans"),
    )


def _sql_rule(i: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT row_no, {i} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
      's': list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT,
      'n': length(h[i]), 'v': length(v[i])}})) AS m
    FROM (SELECT row_no, regexp_extract_all(text, '{p}') AS h, regexp_extract_all(text, '{p}', {rule.group}) AS v,
      regexp_split_to_array(text, '{p}') AS g FROM docs WHERE regexp_matches(text, '{_sieve(rule).replace("'", "''")}'))"""


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(f"SELECT * FROM ({_sql_rule(i, r)}) WHERE m.v >= {r.least}" for i, r in enumerate(RULES))}),
listed AS (
  SELECT row_no, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || m.s || ':' || (m.s + m.n), ',' ORDER BY m.s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || m.s || ':' || (m.s + m.n), ',' ORDER BY m.s, rank) AS spans
  FROM found GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row_no)
"""
