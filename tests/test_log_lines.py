"""The synthetic log has an address for every user."""

from pyspark.sql import functions as F

from banstream.functions.addresses import is_ip
from banstream.plans.lines import address


def test_every_user_has_an_address_of_its_own(spark):
    users = [0, 255, 256, 1499, 65_535, 65_536, 1_500_000, (1 << 24) - 1, 1 << 24, (1 << 24) + 1, 1 << 32, 1 << 40]
    got = spark.createDataFrame([(u,) for u in users], "user long").select("user", address(F.col("user")).alias("ip")).select("user", "ip", is_ip(F.col("ip")).alias("good")).collect()
    assert all(r["good"] for r in got) and len({r["ip"] for r in got}) == len(users)
    assert all(r["ip"] == f"203.0.{r['user'] // 256}.{r['user'] % 256}" for r in got if r["user"] < 65_536)
