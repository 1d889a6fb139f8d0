"""A view of policy-like texts made from the customer and nation tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Text of a row with customer key k and lower-case nation name nat. Between them the variants hold
#: something for every rule of the text functions.
TEXT = """
'Report for ' || nat || chr(10) || 'Page ' || CAST(1 + k % 40 AS STRING) || ' of 40' || chr(10)
 || 'The ' || nat || ' government will reduce emissions by ' || CAST(k % 90 AS STRING)
 || ' percent by the year ' || CAST(2015 + k % 50 AS STRING) || '. '
 || CASE k % 6 WHEN 0 THEN 'Funding of $5bn supports coastal protection and renewable energy!'
      WHEN 1 THEN 'A committee tracks monitoring and reporting under the Paris Agreement (see figure 4)?'
      WHEN 2 THEN 'Hydrogen research helps each vulnerable community.'
      WHEN 3 THEN 'Warming and heat increase with higher rainfall and severe wind storms.'
      WHEN 4 THEN 'Cooling will reduce temperature while lower humidity and mild wind follow.'
      ELSE 'Table 2: Carbon dioxide by transport sector.' END
 || CASE k % 11 WHEN 0 THEN ' A plant emits ' || CAST(k % 70 AS STRING) || ' MtCO2e and 3 GtCO2, with 40 kwh and two gigatonnes more.'
      WHEN 1 THEN ' Around 20% of forty villages, less than 30% of ninety towns and 10-20% of a million people ask to reduce emissions by __%, in 5-___% of cases.'
      WHEN 2 THEN chr(10) || 'Introduction' || chr(10) || 'the targets follow.Next come results...' || chr(10) || 'Monitoring works well!! Does it??' || chr(10) || 'annex b of the plan' || chr(10) || 'goes on here' || chr(10) || chr(10) || 'It stays [12] and (3).'
      WHEN 3 THEN ' Whereas the parties met,' || chr(10) || 'they hereby acknowledge it, and now therefore act in witness whereof on 12/31/2030 in united states and china.'
      WHEN 4 THEN ' Methane and nitrous oxide are greenhouse gases; emission reductions need energy efficiency in ' || chr(39) || '25.' || chr(10) || 'References' || chr(10) || 'a list of works' || chr(10) || chr(10) || 'after it'
      WHEN 5 THEN ' Rs. 7 million and 4 billion usd were spent on a coop-' || chr(10) || '  eration; $9m came later.'
      ELSE '' END
 || chr(10) || chr(10)
 || CASE WHEN k % 2 = 0 THEN 'This policy framework began on ' || CAST(1 + k % 28 AS STRING) || ' March 2031.'
      ELSE 'The plan ended on December ' || CAST(1 + k % 28 AS STRING) || ', 2032.' END
 || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10)
      || 'This measure repeats itself for everyone. This measure repeats itself for everyone.'
      ELSE '' END
 || CASE WHEN k % 7 = 0 THEN chr(10) || chr(10) || 'A paragraph that comes back.' || chr(10) || chr(10) || 'short' || chr(10) || chr(10) || 'A  Paragraph that comes BACK.' ELSE '' END
"""

CTE = f"p AS (SELECT c_custkey AS k, lower(n_name) AS nat FROM customer JOIN nation ON c_nationkey = n_nationkey), policy_docs AS (SELECT k AS doc_id, {TEXT} AS text FROM p)"


#: Texts of a partition: of large tables, and at least while there are cores without one.
LARGE, SMALL = 5_000, 500


def policy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text); the nations, 25 rows, are broadcast by their size.

    A customer takes a few bytes of a file, so a million of them may be one partition; they are dealt by key before their
    texts are made, and what is grouped by doc_id later stays where it is.
    """
    customer, nation = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation")
    rows = customer.count()
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-rows // SMALL)), -(-rows // LARGE))
    joined = customer.repartition(parts, "c_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.lower("n_name").alias("nat"))
    return joined.select(F.col("k").alias("doc_id"), F.expr(TEXT).alias("text"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label) of nations and regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.select(F.col("n_name").alias("name"), F.lit("GPE").alias("label")).union(region.select(F.col("r_name"), F.lit("GPE")))
