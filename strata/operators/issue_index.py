"""Index of issues for many searches: grams and the issues that hold them.

An issue is found by a text if its path, message, family or rule holds it, whatever its case.  The index has a posting
for every string of one to ``GRAM`` characters in these fields: the issues' numbers in blocks of ``BLOCK``, as sorted offsets
(under 65,536, which Parquet's dictionary pages pack to 16 bits or fewer), and a second table has them for strings of up to
``LONG`` characters.  A query of up to ``LONG`` characters is one gram and its posting the answer, so what is read grows
with what is found.  A longer one is looked up by its ``RAREST`` rarest grams of ``LONG`` characters; issues in all of their
postings are compared with the query, as grams may stand apart.  Queries meet postings and issues by joins on gram
and number, however many queries there are; no query reads the table of issues from end to end, nor the texts that
the issues were found in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.positions import positions
from strata.session import land

GRAM = 3
LONG = 8
RAREST = 3
BLOCK = 1 << 16
FIELDS = ["file_path", "message", "defect_family", "rule_id"]


@dataclass
class IssueIndex:
    """Written tables: issues (with ``issue_no``), and postings (gram, block, offsets, issues) of grams of up to ``GRAM``
    and of up to ``LONG`` characters."""

    issues: DataFrame
    postings: DataFrame
    long_postings: DataFrame


def _grams(text: Column, sizes: range) -> Column:
    """Every substring of the sizes, as often as it stands."""
    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
                      ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in sizes]))


def _lower(field: str) -> Column:
    return F.lower(F.coalesce(F.col(field), F.lit("")))


def build_issue_index(issues: DataFrame) -> IssueIndex:
    """Numbers the issues by repository, file, line and rule, and writes the tables."""
    order = [F.col(c) for c in ("repo_id", "file_path", "line_number", "rule_id")]
    numbered = land(positions(issues, [], order, "issue_no"), "indexed-issues")

    def postings(sizes: range, name: str) -> DataFrame:
        grams = F.array_distinct(F.flatten(F.array(*[_grams(_lower(f), sizes) for f in FIELDS])))
        held = numbered.select("issue_no", F.explode(grams).alias("gram"))
        # a posting is cut into blocks, so a gram that all issues have is many rows of bounded size
        return land(held.groupBy("gram", F.floor(F.col("issue_no") / BLOCK).alias("block")).agg(
            F.sort_array(F.collect_list((F.col("issue_no") % BLOCK).cast("int"))).alias("offsets"), F.count(F.lit(1)).alias("issues")), name)

    return IssueIndex(numbered, postings(range(1, GRAM + 1), "postings"), postings(range(GRAM + 1, LONG + 1), "long-postings"))


def search_index(index: IssueIndex, queries: DataFrame) -> DataFrame:
    """query, and the columns of the issues found, for every distinct text of ``queries`` (column ``query``).

    An empty query finds every issue, a null query none.
    """
    asked = queries.select("query").filter("query IS NOT NULL").distinct().withColumn("_low", F.lower("query"))
    size = F.length("_low")
    short = asked.filter((size > 0) & (size <= GRAM)).select("query", F.col("_low").alias("gram"))
    middle = asked.filter((size > GRAM) & (size <= LONG)).select("query", F.col("_low").alias("gram"))
    parts = asked.filter(size > LONG).select("query", F.explode(F.array_distinct(_grams(F.col("_low"), range(LONG, LONG + 1)))).alias("gram"))
    totals = index.long_postings.filter(F.length("gram") == LONG).groupBy("gram").agg(F.sum("issues").alias("_issues"))
    rare = Window.partitionBy("query").orderBy("_issues", "gram")  # a query's own grams
    # a gram that stands nowhere has no posting: its query is asked for with more grams than can be found
    chosen = (parts.join(totals, "gram", "left").withColumn("_issues", F.coalesce("_issues", F.lit(0)))
              .withColumn("_k", F.row_number().over(rare)).filter(F.col("_k") <= RAREST)
              .withColumn("_need", F.count(F.lit(1)).over(Window.partitionBy("query"))))

    def numbers(wanted: DataFrame, postings: DataFrame, *keep: str) -> DataFrame:
        return wanted.join(postings, "gram").select("query", *keep, "block", F.explode("offsets").alias("_o")).select(
            "query", *keep, (F.col("block") * BLOCK + F.col("_o")).alias("issue_no"))

    exact = numbers(short, index.postings).union(numbers(middle, index.long_postings)).join(index.issues, "issue_no")
    near = (numbers(chosen, index.long_postings, "_need").groupBy("query", "issue_no", "_need").agg(F.count(F.lit(1)).alias("_n"))
            .filter("_n = _need").select("query", "issue_no").join(index.issues, "issue_no"))
    holds = F.lit(False)
    for f in FIELDS:
        holds = holds | _lower(f).contains(F.lower("query"))
    columns = ["query", *index.issues.columns]
    everything = index.issues.withColumn("query", F.lit("")).join(asked.filter(size == 0).select("query"), "query", "left_semi")
    return exact.select(*columns).union(near.filter(holds).select(*columns)).union(everything.select(*columns))
