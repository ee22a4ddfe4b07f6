"""Public test vectors (BIP-173/350, EIP-55) and the naming rules."""
import pytest
from pyspark.sql import functions as F

from attestra.functions import identifiers as I

GOOD_BTC = ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4",
            "bc1p5d7rjq7g6rdk2yhzks9smlaqtedr4dekq08ge8ztwac72sfr9rusxg3297", "BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4",
            "1111111111111111111114oLvT2"]
BAD_BTC = ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", "not-an-address", "", None,
           "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kemeawh", "bc1p5d7rjq7g6rdk2yhzks9smlaqtedr4dekq08ge8ztwac72sfr9rusn5pxqu",
           "bc1Qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "bc1", "1" * 34, "0x52908400098527886e0f7030069857d2e4169ee7", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN€"]
EVM = {"0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed": "valid", "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359": "valid",
       "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB": "valid", "0xD1220A0cf47c7B9Be7A2E6BA89F429762e7b9aDb": "valid",
       "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAeD": "invalid", "0x52908400098527886E0F7030069857D2E4169EE7": "not_encoded",
       "0xde709f2102306220921060314715629080e2fb77": "not_encoded", "0x123": None, "0x52908400098527886e0f7030069857d2e4169ee7\n": None,
       " 0x52908400098527886e0f7030069857d2e4169ee7": None, "": None}


#: (chain, value, valid, checksum state), published test vectors
VECTORS = [
    ("ethereum", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", True, "valid"),
    ("ethereum", "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", True, "valid"),
    ("polygon", "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB", True, "valid"),
    ("ethereum", "0x5AAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", False, "invalid"),
    ("ethereum", "0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed", True, "not_encoded"),
    ("ethereum", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeA", False, None),
    ("bitcoin", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", True, None),
    ("bitcoin", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3", False, None),
    ("bitcoin", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", True, None),
    ("bitcoin", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", True, None),
    ("bitcoin", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", False, None),
    ("bitcoin", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", True, None),
    ("dogecoin", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", False, None)]


def test_bitcoin_checksums(spark, reg):
    df = spark.createDataFrame([(v,) for v in GOOD_BTC + BAD_BTC], "v string")
    got = [r[0] for r in df.select(I.address_valid(reg, F.lit("bitcoin"), F.col("v"))).collect()]
    assert got == [True] * len(GOOD_BTC) + [False] * len(BAD_BTC)


def test_mixed_case_checksum(spark, reg):
    df = spark.createDataFrame([(v,) for v in EVM], "v string")
    got = {r.v: r.s for r in df.select("v", I.checksum_state(F.col("v")).alias("s")).collect()}
    assert got == EVM
    ok = {r.v: r.s for r in df.select("v", I.address_valid(reg, F.lit("polygon"), F.col("v")).alias("s")).collect()}
    assert ok == {v: s in ("valid", "not_encoded") for v, s in EVM.items()}


def test_checksums_survive_batches_without_candidates(spark):
    df = spark.range(0, 30, 1, 3).select(F.lit(None).cast("string").alias("v"))
    assert df.where(I.mixed_case_checksum("v").isNull() & I.base58_payload("v").isNull() & I.segwit_checksum("v").isNull()).count() == 30


def test_transaction_hashes(spark, reg):
    df = spark.createDataFrame([("a" * 64,), ("0x" + "a" * 64,), ("z" * 64,), ("a" * 63,)], "v string")
    assert [r[0] for r in df.select(I.transaction_valid(reg, "bitcoin", F.col("v"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(I.transaction_valid(reg, "ethereum", F.col("v"))).collect()] == [False, True, False, False]


@pytest.mark.parametrize("name,chain", [("Polygon-Mainnet", "polygon"), (" BTC ", "bitcoin"), ("eth mainnet", "ethereum"), ("ropsten testnet", None),
                                        ("eth_testnet", None), ("", None), (None, None), ("Binance Smart Chain", "bnb_smart_chain")])
def test_chain_names(spark, reg, name, chain):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(I.resolve_chain(reg, F.col("n"))).first()[0] == chain


def test_spelling_and_subjects(spark, reg):
    df = spark.createDataFrame([('"BC1QABC"', "ethereum", "0xAB"), (" 1AbC ", None, "0xAB"), ("1AbC", "bitcoin", "0xAB")], "raw string, chain string, hex string")
    got = df.select(I.adapter_address(F.col("raw")), I.subject_key(F.col("chain"), F.col("hex")), I.canonical_identifier(reg, F.col("chain"), F.col("hex"))).collect()
    assert [tuple(r) for r in got] == [("bc1qabc", "ethereum:0xAB", "0xab"), ("1AbC", "0xAB", "0xAB"), ("1AbC", "bitcoin:0xAB", "0xAB")]


def test_published_vectors_and_their_spelling(spark, reg):
    rows = spark.createDataFrame(VECTORS, "chain string, value string, valid boolean, state string").repartition(3)
    got = rows.select("chain", "value", "valid", "state", I.address_valid(reg, F.col("chain"), F.col("value")).alias("v"), I.checksum_state(F.col("value")).alias("s")).collect()
    assert all(r.valid == r.v and r.state == r.s for r in got)
    # the encoders give back every valid spelling
    case = spark.createDataFrame([(v,) for v, s in EVM.items() if s == "valid"] + [(None,)], "v string")
    assert all(r.v is None and r.w is None or r.v == r.w for r in case.select("v", F.concat(F.lit("0x"), I.mixed_case(F.lower(F.substring("v", 3, 40)))).alias("w")).collect())
    old = spark.createDataFrame([(v,) for v in GOOD_BTC if v[0] in "13"] + [(None,)], "v string")
    assert all(r.v == r.w for r in old.select("v", I.base58check(F.substring(I.base58_payload("v"), 1, 21)).alias("w")).collect())
    programs = [(0, "751e76e8199196d454941c45d1b3a323f1433bd6", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"), (None, None, None),
                (1, "79be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"),
                (16, "751e", "bc1sw50qgdz25j"), (2, "751e76e8199196d454941c45d1b3a323", "bc1zw508d6qejxtdg4y5r3zarvaryvaxxpcs")]
    df = spark.createDataFrame(programs, "v int, p string, want string").repartition(2)
    assert all(r.want == r.got for r in df.select("want", I.segwit("v", F.unhex("p")).alias("got")).collect())


def test_a_registered_family_is_used_everywhere(spark, reg):
    fits = I.Family(lambda v: F.lower(v).rlike("^rec-[0-9]+$"), lambda v: v.rlike("^tx-[0-9]+$"), F.lower)
    more = reg.with_family("records", fits, {"ledger": ["my ledger", "ldg"]})
    df = spark.createDataFrame([("ledger", "REC-1"), ("ledger", "x"), ("ethereum", "rec-1"), ("bitcoin", GOOD_BTC[0]), (None, "rec-1"), ("ledger", None)], "c string, v string")
    assert [r[0] for r in df.select(I.address_valid(more, F.col("c"), F.col("v"))).collect()] == [True, False, False, True, False, False]
    assert [r[0] for r in df.select(I.canonical_identifier(more, F.col("c"), F.col("v"))).collect()][:3] == ["rec-1", "x", "rec-1"]
    assert df.select(I.resolve_chain(more, F.lit("My Ledger Mainnet")), I.resolve_chain(reg, F.lit("ldg")), I.transaction_valid(more, "ledger", F.lit("tx-9"))).first()[:] == ("ledger", None, True)
    assert "ledger" not in reg.chains and reg.families == {}
    for bad in (lambda: reg.with_family("evm", fits, {"x": []}), lambda: reg.with_family("r", fits, {"bitcoin": []}), lambda: reg.with_family("r", fits, {"x": ["eth"]}), lambda: more.with_family("s", fits, {"y": ["a", "A"]})):
        with pytest.raises(ValueError):
            bad()
