"""The frames named queries start from, and the same as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lotwise.operators.clean import Cuts
from lotwise.plans import price_models as flow
from lotwise.session import stage
from lotwise.sources.listings import listing_view

KEYS = ("order_key", "line_no")
# Only the price band: the other cuts of the study would leave few rows of these tables.
BAND = Cuts(mileage=None, levy=None, engine=None, cylinders=None, age=None)
# Maker means of these tables lie close together, so the bins are narrower than the study's.
EDGES = (25000.0, 25500.0, 26000.0, 26500.0, float("inf"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    return listing_view(spark, folder)


def banded(spark: SparkSession, folder: str) -> DataFrame:
    return flow.kept_listings(listing(spark, folder), BAND, KEYS, dedupe=False)


def kept(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the banded rows that a query reads more than once, staged."""
    return stage(banded(spark, folder).select(*columns), "kept-listings")


def imputed(spark: SparkSession, folder: str) -> DataFrame:
    return flow.imputed_listings(listing(spark, folder), BAND, KEYS, dedupe=False)


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    return flow.encode_listings(imputed(spark, folder))


LISTING = """listing as (
  select l_orderkey as order_key, l_linenumber as line_no, l_extendedprice as price,
    case when l_linenumber % 3 = 0 or l_quantity = 1 or (l_quantity = 2 and p_type = 'PROMO')
         then '-' else cast(p_size * 20 + l_linenumber * 10 as varchar) end as levy_text,
    p_brand as maker, p_type as category, l_returnflag as gearbox, o_orderstatus as drive,
    cast(year(l_shipdate) as int) as prod_year,
    case when l_linenumber <= 3 then 'Yes' when l_linenumber <= 6 then 'No' else '?' end as leather_text,
    concat(cast(cast(l_quantity as int) as varchar), case when p_size % 4 = 0 then ' Turbo' else '' end) as engine_text,
    concat(cast(l_partkey as varchar), ',', lpad(cast(l_suppkey as varchar), 3, '0'), ' km') as mileage_text,
    cast(p_size % 12 + 1 as varchar) as cylinders_text, cast(l_linenumber as varchar) as airbags_text
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""

PARSED = (
    LISTING
    + """, parsed as (
  select order_key, line_no, cast(price as double) as price,
    try_cast(nullif(levy_text, '-') as double) as levy, maker, category,
    case leather_text when 'Yes' then 1 when 'No' then 0 end as leather,
    cast(replace(engine_text, ' Turbo', '') as double) as engine,
    try_cast(replace(replace(mileage_text, ' km', ''), ',', '') as double) as mileage,
    try_cast(cylinders_text as double) as cylinders, gearbox, drive,
    try_cast(airbags_text as double) as airbags,
    cast(contains(engine_text, 'Turbo') as int) as turbo, 2022 - prod_year as age
  from listing)"""
)

BANDED = PARSED + ", banded as (select * from parsed where price between 2000 and 50000)"

IMPUTED = (
    BANDED
    + """, m2 as (select engine, category, median(levy) as m from banded group by all),
  m1 as (select engine, median(levy) as m from banded group by all),
  m0 as (select median(levy) as m from banded),
  imputed as (select b.* replace (coalesce(b.levy, m2.m, m1.m, m0.m) as levy)
    from banded b left join m2 on b.engine = m2.engine and b.category = m2.category
    left join m1 on b.engine = m1.engine cross join m0)"""
)

ENCODED = (
    IMPUTED
    + """, crank as (select category, cast(row_number() over (order by avg(price), category) as int) as category_encoded
    from imputed group by category),
  grank as (select gearbox, cast(row_number() over (order by avg(price), gearbox) as int) as gearbox_encoded
    from imputed group by gearbox),
  encoded as (select i.*, category_encoded, gearbox_encoded, cast(drive = 'F' as int) as drive_F,
      cast(drive = 'O' as int) as drive_O, cast(drive = 'P' as int) as drive_P
    from imputed i left join crank on i.category = crank.category left join grank on i.gearbox = grank.gearbox)"""
)


def is_test(key: str = "order_key", seed: str = "42", buckets: int = 5) -> str:
    return f"(('0x' || substr(md5(cast({key} as varchar) || '{seed}'), 1, 8))::bigint % {buckets} = 0)"


SPLIT = (
    ENCODED
    + f""", split as (select *, case when {is_test()} then 'test' else 'train' end as split from encoded)"""
)

# Maker code from train rows; a maker without a code gets the row-weighted median code.
CODED = (
    SPLIT
    + """, mk as (select maker, avg(price) as mean, count(*) as n from split where split = 'train' group by maker),
  mcode as (select maker, n, case when mean > 26500 then 4.0::double when mean > 26000 then 3.0::double
      when mean > 25500 then 2.0::double when mean > 25000 then 1.0::double end as code from mk),
  mmed as (select median(code) as med from split s join mcode on s.maker = mcode.maker where s.split = 'train'),
  coded as (select s.*, coalesce(mcode.code, mmed.med) as maker_encoded
    from split s left join mcode on s.maker = mcode.maker cross join mmed)"""
)
