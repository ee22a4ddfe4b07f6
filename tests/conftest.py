import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from attestra import Registry  # noqa: E402
from attestra.session import local_session  # noqa: E402

COLUMNS = ("claim_seq bigint, chain string, address string, source string, raw_label string, canon string, polarity string, prov_family string, "
           "lastmod string, heuristic string, subcat string, root string, prov_resolved boolean, prov_native boolean, prov_verified boolean, "
           "prov_kind string, root_known boolean, subject string")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def reg():
    return Registry.load()


@pytest.fixture
def make(spark, reg):
    """Claims from dicts; anything not given takes a neutral value."""
    def build(rows):
        out = []
        for i, r in enumerate(rows):
            canon = r.get("canon", "mixer")
            cat = reg.categories.get(canon)
            known = r.get("known", r.get("resolved", True))
            chain, addr = r.get("chain"), r.get("address", "a1")
            out.append((r.get("seq", i), chain, addr, r.get("source", "a"), r.get("raw_label", canon), canon, cat.polarity if cat else "unknown",
                        r.get("prov_family", ""), r.get("lastmod", ""), r.get("heuristic", ""), r.get("subcat", ""), r.get("root", "r"),
                        r.get("resolved", known), r.get("native", False), r.get("verified", False), r.get("kind", "DECLARED"), known,
                        f"{chain}:{addr}" if chain else addr))
        return spark.createDataFrame(out, COLUMNS)
    return build


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def day(text):
    return F.lit(text).cast("date")
