"""A corpus of small source files derived from the ``orders`` table, alike in Spark SQL and DuckDB.

Values are assembled from digests when the query runs, so the repository holds nothing that looks like a credential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import spread

TAG = "credsift"

#: {orders} is the table. Both engines read this text.
CORPUS_SQL = """
SELECT path, concat(head, chr(10), body, chr(10), tail) AS text FROM (
  SELECT
    CASE k % 9
      WHEN 0 THEN concat('app/config_', k, '.rb') WHEN 1 THEN concat('src/client_', k, '.py') WHEN 2 THEN concat('spec/fixture_', k, '.rb')
      WHEN 3 THEN concat('docs/setup_', k, '.md') WHEN 4 THEN concat('infra/values_', k, '.yaml') WHEN 5 THEN concat('svc_', k, '/.env.local')
      WHEN 6 THEN concat('bin/blob_', k, '.png') WHEN 7 THEN concat('lib/x_', k, '.js') ELSE concat('.claude/worktrees/w/x_', k, '.rb') END AS path,
    CASE WHEN k % 11 = 0 THEN concat('# credsift', ':allow') WHEN k % 13 = 0 THEN concat('# credsift', ':allow secret_assignment reason="known"') ELSE concat('# file ', k) END AS head,
    CASE k % 21
      WHEN 0 THEN concat('aws_access_key_id = "AK', 'IA', upper(substr(h, 1, 16)), '"')
      WHEN 1 THEN concat('STRIPE_KEY: sk', '_live_', substr(h, 1, 24))
      WHEN 2 THEN concat('token=gh', 'p_', h, substr(h, 1, 8))
      WHEN 3 THEN concat('slack = xo', 'xb-', substr(h, 1, 24))
      WHEN 4 THEN concat('DATABASE_URL=postgres', '://user:', substr(h, 1, 10), '@db.host/x')
      WHEN 5 THEN concat('-----BEGIN RSA PRI', 'VATE KEY-----')
      WHEN 6 THEN concat('password = "', substr(h, 1, 16), '"')
      WHEN 7 THEN concat('password = "change', 'me_changeme"')
      WHEN 8 THEN concat('db_secret: "$', '{{DB_PASSWORD_VALUE}}"')
      WHEN 9 THEN 'token = "************"'
      WHEN 10 THEN concat('dd_api_key: ', h)
      WHEN 11 THEN concat('mail ', h, '-us', k % 10)
      WHEN 12 THEN concat('bot 12345678:', substr(concat(h, h), 1, 35))
      WHEN 13 THEN concat('SG', '.', substr(h, 1, 22), '.', substr(concat(h, h), 1, 43))
      WHEN 14 THEN concat('jwt ey', 'J', h, '.ey', 'J', h, '.', h)
      WHEN 15 THEN concat('two AK', 'IA', upper(substr(h, 1, 16)), ' and AK', 'IA', upper(substr(h, 5, 16)), ' end')
      WHEN 16 THEN concat(repeat('x', 9000), ' AK', 'IA', upper(substr(h, 1, 16)))
      WHEN 17 THEN concat('api_key = "', substr(h, 1, 20), '"  # from_secret')
      WHEN 18 THEN concat('aws_secret_access', '_key = "', h, substr(h, 1, 8), '"')
      WHEN 19 THEN concat('aws_session', '_token: ', h, h, h, h)
      ELSE concat('secret = "prod/', substr(h, 1, 8), '/db-password"') END AS body,
    CASE k % 5
      WHEN 0 THEN concat('passwd: "', substr(h, 9, 14), '"', chr(13)) WHEN 1 THEN concat('shop: acme-', k % 7, '.myshopify.com shp', 'at_', h)
      WHEN 2 THEN concat('anthropic sk', '-ant-', h, substr(h, 1, 12)) WHEN 3 THEN concat('AK', 'IA', 'IOSFODNN7EXAMPLE') ELSE 'end' END AS tail
  FROM (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS STRING)) AS h FROM {orders}) AS keyed
) AS files
"""

#: The ignore files of that tree. {orders} is the table; both engines read this text.
IGNORE_SQL = """
SELECT '.gitignore' AS path, concat('*.js', chr(10), '!x_7*.js', chr(10), '/docs/', chr(10), '# note', chr(10), 'svc_1*/', chr(10), '!svc_1*/.env.local', chr(10)) AS text
UNION ALL SELECT 'lib/.ignore', concat('!x_3*.js', chr(13), chr(10), 'x_31*.js')
UNION ALL SELECT 'app/.gitignore', concat('config_?.rb  ', chr(10), 'config_1[0-4]*.rb', chr(10), '!config_12*.rb')
UNION ALL SELECT '.git/info/exclude', concat('spec/**', chr(10), 'infra/*_1*.yaml')
UNION ALL SELECT concat('svc_', o_orderkey, '/.gitignore'), CASE WHEN o_orderkey % 8 = 0 THEN concat('.env*', chr(10), '!.env.local') ELSE '.env*' END FROM {orders} WHERE o_orderkey % 9 = 5 AND o_orderkey % 4 = 0
"""


def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: ignore files at the root, in folders, and in a part of the services' folders."""
    return spark.sql(IGNORE_SQL, orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: one small file for each order."""
    return spark.sql(CORPUS_SQL, orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")))


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: the ``documents`` table, each row a text file."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select(F.concat(F.lit("docs_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
