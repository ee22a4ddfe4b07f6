"""Identifiers: canonical spelling, subject keys, chain names and validity.

Syntax is decided by built-in expressions.  Only the three checksums that the JVM side
lacks (Keccak for mixed-case hex, Base58 and Bech32 decoding) cross to Python, in Arrow
batches, computed column-wise with NumPy, and only for the rows that need them.
"""
from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import Family, Registry
from .text import lookup, strip

EVM_ADDRESS, EVM_HASH, BTC_HASH = (r"\A0x[0-9a-fA-F]{40}\z", r"\A0x[0-9a-fA-F]{64}\z", r"\A[0-9a-fA-F]{64}\z")


# ------------------------------------------------------------------ naming
def adapter_address(raw: Column) -> Column:
    """Spelling used when a source file is read: quotes off, segwit lower-cased."""
    a = F.trim(strip(F.coalesce(raw, F.lit(""))), F.lit('"'))
    return F.when(F.lower(F.substring(a, 1, 3)).isin("bc1", "tb1"), F.lower(a)).otherwise(a)


def canonical_identifier(reg: Registry, chain: Column, raw: Column) -> Column:
    """One spelling per identifier (a trimmed cell), by the rule of its chain's family: hexadecimal chains ignore case, Bitcoin does not."""
    spelled = [(chains_of(reg, n), f.spelled) for n, f in families(reg).items() if f.spelled and chains_of(reg, n)]
    return reduce(lambda out, rule: out.when(chain.isin(rule[0]), rule[1](raw)), spelled, F.when(F.lit(False), raw)).otherwise(raw)


def subject_key(chain: Column, address: Column) -> Column:
    """What a claim is about.  The same string on two chains is two subjects."""
    return F.when(F.coalesce(chain, F.lit("")) != "", F.concat(chain, F.lit(":"), address)).otherwise(address)


def resolve_chain(reg: Registry, name: Column) -> Column:
    """Supported chain a name refers to, else NULL.  A test network never resolves."""
    low = F.lower(strip(F.coalesce(name, F.lit(""))))
    n = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    suffixes = "|".join(re.escape(s) for s in reg.intake["chains"]["network_suffixes"])
    # most cells are an alias as they stand; only the others are taken apart
    return F.coalesce(lookup(reg.chain_aliases, low), lookup(reg.chain_aliases, F.regexp_replace(n, f"_(?:{suffixes})$", "")))


# ------------------------------------------------------------------ checksums (Arrow batches)
#: Fixed values of the Keccak standard: how far lane (x, y) turns, and the constant of each round.
TURNS = [[0, 36, 3, 41, 18], [1, 44, 10, 45, 2], [62, 6, 43, 15, 61], [28, 55, 25, 21, 56], [27, 20, 39, 8, 14]]
ROUNDS = [0x0000000000000001, 0x0000000000008082, 0x800000000000808A, 0x8000000080008000, 0x000000000000808B, 0x0000000080000001, 0x8000000080008081, 0x8000000000008009,
          0x000000000000008A, 0x0000000000000088, 0x0000000080008009, 0x000000008000000A, 0x000000008000808B, 0x800000000000008B, 0x8000000000008089, 0x8000000000008003,
          0x8000000000008002, 0x8000000000000080, 0x000000000000800A, 0x800000008000000A, 0x8000000080008081, 0x8000000000008080, 0x0000000080000001, 0x8000000080008008]
_TURN = np.array(TURNS, np.uint64)[:, :, None]
_X, _Y = np.meshgrid(np.arange(5), np.arange(5), indexing="ij")


def _turned(lanes: np.ndarray, by: np.ndarray) -> np.ndarray:
    return (lanes << by) | (lanes >> ((np.uint64(64) - by) & np.uint64(63)))


def _keccak_first_lanes(blocks: np.ndarray) -> np.ndarray:
    """First three 64-bit lanes of Keccak-256 for rows of 40 ASCII bytes; the state is one array (x, y, row)."""
    state = np.zeros((5, 5, len(blocks)), np.uint64)
    state[:, 0] = np.ascontiguousarray(blocks).view("<u8").T
    state[0, 1] ^= np.uint64(1)                                                  # the padding's first and last bit
    state[1, 3] ^= np.uint64(1 << 63)
    for constant in ROUNDS:
        columns = np.bitwise_xor.reduce(state, axis=1)
        mixed = np.roll(columns, 1, axis=0) ^ _turned(np.roll(columns, -1, axis=0), np.uint64(1))
        moved = np.empty_like(state)
        moved[_Y, (2 * _X + 3 * _Y) % 5] = _turned(state ^ mixed[:, None], _TURN)
        state = moved ^ (~np.roll(moved, -1, axis=0) & np.roll(moved, -2, axis=0))
        state[0, 0] ^= np.uint64(constant)
    return state[:3, 0].T


def _nibbles(low: np.ndarray) -> np.ndarray:
    """The 40 half-bytes of the hash of each row of 40 lower-case hex characters."""
    digest = np.ascontiguousarray(_keccak_first_lanes(low).astype("<u8")).view(np.uint8).reshape(len(low), 24)[:, :20]
    return np.stack([digest >> 4, digest & 15], axis=2).reshape(len(low), 40)


def _chars(values: pd.Series, width: int) -> np.ndarray:
    """Rows of character codes, zero-padded; anything outside ASCII becomes '?'."""
    raw = np.array([v.encode("ascii", "replace") for v in values], dtype=f"S{width}")
    return raw.view(np.uint8).reshape(len(raw), width)


def _nulls(n: int, kind: pa.DataType) -> pd.Series:
    """A batch in which no row needed the check: Arrow nulls, without a Python object per row."""
    return pd.Series(pd.arrays.ArrowExtensionArray(pa.nulls(n, kind)))


def _scattered(asked: np.ndarray, answers: np.ndarray) -> pd.Series:
    values = np.zeros(len(asked), bool)
    values[asked] = answers
    return pd.Series(pd.arrays.BooleanArray(values, ~asked))


@F.pandas_udf(T.BooleanType())
def mixed_case_checksum(body: pd.Series) -> pd.Series:
    """EIP-55: is the letter case of 40 mixed-case hex characters the one their hash asks for?"""
    asked = body.notna().to_numpy()
    todo = body[asked]
    if len(todo):
        given = _chars(todo, 40)
        low = np.where((given >= 65) & (given <= 70), given + 32, given).astype(np.uint8)
        letter = low >= 97
        return _scattered(asked, (~letter | ((given < 97) == (_nibbles(low) >= 8))).all(axis=1))
    return _nulls(len(body), pa.bool_())


ALPHABET_58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"       # fixed value
_B58 = np.full(256, 255, np.uint8)
for _i, _c in enumerate(ALPHABET_58):
    _B58[_c] = _i


@F.pandas_udf(T.BinaryType())
def base58_payload(value: pd.Series) -> pd.Series:
    """The 25 bytes a Base58 address encodes, NULL when it does not encode exactly that many."""
    asked = value.notna()
    if not asked.any():
        return _nulls(len(value), pa.binary())
    out = pd.Series([None] * len(value), dtype=object)
    ok = asked & (value.str.len() >= 25) & (value.str.len() <= 35)
    todo = value[ok]
    if len(todo):
        size = todo.str.len().to_numpy()
        codes = _chars(todo, 35)
        digit = _B58[codes].astype(np.int64)
        inside = np.arange(35)[None, :] < size[:, None]
        valid = ((digit < 58) | ~inside).all(axis=1)
        limbs = np.zeros((len(todo), 9), np.int64)          # 9 x 24 bits, least significant first
        for j in range(35):
            use = inside[:, j]
            carry = np.where(use, digit[:, j], 0)
            for k in range(9):
                v = limbs[:, k] * np.where(use, 58, 1) + carry
                limbs[:, k], carry = v & 0xFFFFFF, v >> 24
        big = np.stack([(limbs[:, 8 - k // 3] >> (16 - 8 * (k % 3))) & 255 for k in range(27)], axis=1).astype(np.uint8)
        filled = big[:, 2:] != 0
        lead = np.where(filled.any(axis=1), filled.argmax(axis=1), 25)
        ones = np.where((codes == ord("1")) & inside, 1, 0)
        pad = np.where(ones.all(axis=1), 35, ones.argmin(axis=1))
        good = valid & (big[:, :2] == 0).all(axis=1) & (lead == np.minimum(pad, size))
        out[ok.to_numpy()] = [bytes(b) if g else None for b, g in zip(big[:, 2:], good)]
    return out


ALPHABET_32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"       # fixed value of BIP-173
_B32 = np.full(256, 255, np.uint8)
for _i, _c in enumerate(ALPHABET_32):
    _B32[_c] = _i
_BECH32, _BECH32M = 1, 0x2BC830A3            # fixed values of BIP-173 and BIP-350
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def _folded(check: np.ndarray, value: np.ndarray | int) -> np.ndarray:
    """The Bech32 checksum after one more value of five bits."""
    top = check >> 25
    out = ((check & 0x1FFFFFF) << 5) ^ value
    for i, g in enumerate(_GENERATOR):
        out ^= np.where((top >> i) & 1, g, 0)
    return out


@F.pandas_udf(T.BooleanType())
def segwit_checksum(value: pd.Series) -> pd.Series:
    """Is a lower-case ``bc1...`` string a valid witness address for its version?"""
    asked = value.notna().to_numpy()
    todo = value[asked]
    if len(todo):
        size = todo.str.len().to_numpy() - 3
        room = np.minimum(size, 87)
        data = _B32[_chars(todo.str.slice(3), 87)].astype(np.int64)
        inside = np.arange(87)[None, :] < room[:, None]
        good = (size >= 7) & (size <= 87) & ((data < 32) | ~inside).all(axis=1)
        check = np.ones(len(todo), np.int64)

        for v in (3, 3, 0, 2, 3):                            # the prefix "bc", expanded
            check = _folded(check, v)
        for j in range(87):
            check = np.where(inside[:, j], _folded(check, np.where(inside[:, j], data[:, j], 0)), check)
        version, groups = data[:, 0], np.maximum(size - 7, 0)
        length, spare = groups * 5 // 8, groups * 5 % 8
        last = data[np.arange(len(todo)), np.clip(size - 7, 0, 86)]
        clean = (spare < 5) & ((last & ((1 << spare) - 1)) == 0)
        fits = (length >= 2) & (length <= 40) & (version <= 16) & ((version != 0) | np.isin(length, (20, 32)))
        const = np.where(version == 0, _BECH32, _BECH32M)
        return _scattered(asked, good & clean & fits & (check == const))
    return _nulls(len(value), pa.bool_())


# ------------------------------------------------------------------ spelling with a checksum (Arrow batches)
def _texts(asked: np.ndarray, codes: np.ndarray, sizes: np.ndarray | None = None) -> pd.Series:
    """Rows of character codes as text; ``sizes`` says how many at the end of a row count."""
    out, width = np.full(len(asked), None, object), codes.shape[1]
    rows = [r.tobytes().decode("ascii") for r in codes.astype(np.uint8)]
    out[asked] = rows if sizes is None else [r[width - n:] for r, n in zip(rows, sizes.tolist())]
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def mixed_case(body: pd.Series) -> pd.Series:
    """40 hex characters in the letter case their hash asks for (EIP-55)."""
    asked = body.notna().to_numpy()
    if not asked.any():
        return _nulls(len(body), pa.string())
    low = _chars(body[asked].str.lower(), 40)
    return _texts(asked, np.where((low >= 97) & (_nibbles(low) >= 8), low - 32, low))


@F.pandas_udf(T.StringType())
def base58(value: pd.Series) -> pd.Series:
    """25 bytes in Base58: the number in base 58, with a 1 for each leading zero byte."""
    asked = value.notna().to_numpy()
    if not asked.any():
        return _nulls(len(value), pa.string())
    raw = np.frombuffer(b"".join(bytes(v) for v in value[asked]), np.uint8).reshape(-1, 25)
    rest, digits = raw.astype(np.int64), np.zeros((len(raw), 35), np.int64)
    for place in range(34, -1, -1):                              # long division of all rows at once
        carry = np.zeros(len(raw), np.int64)
        for j in range(25):
            carry = carry * 256 + rest[:, j]
            rest[:, j], carry = carry // 58, carry % 58
        digits[:, place] = carry
    zeros = np.where(raw.any(axis=1), (raw != 0).argmax(axis=1), 25)
    used = np.where(digits.any(axis=1), 35 - (digits != 0).argmax(axis=1), 0)
    return _texts(asked, np.frombuffer(ALPHABET_58, np.uint8)[digits], np.minimum(used + zeros, 35))


def base58check(payload: Column) -> Column:
    """A Bitcoin address of 21 bytes (version and hash)."""
    twice = F.unhex(F.sha2(F.unhex(F.sha2(payload, 256)), 256))
    return base58(F.concat(payload, F.substring(twice, 1, 4)))


@F.pandas_udf(T.StringType())
def segwit(version: pd.Series, program: pd.Series) -> pd.Series:
    """A ``bc1`` address of a witness version and program; all programs of a batch are brought to five bits at once, by length."""
    asked = (version.notna() & program.notna()).to_numpy()
    out = np.full(len(asked), None, object)
    size = program.str.len().to_numpy()
    for n in np.unique(size[asked]):
        here = asked & (size == n)
        v = version[here].to_numpy(np.int64)
        raw = np.frombuffer(b"".join(bytes(p) for p in program[here]), np.uint8).reshape(-1, int(n))
        bits = np.unpackbits(raw, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 5))).reshape(len(raw), -1, 5)
        data = np.concatenate([v[:, None], bits @ np.array([16, 8, 4, 2, 1])], axis=1)
        check = np.ones(len(raw), np.int64)
        for value in (3, 3, 0, 2, 3, *data.T, 0, 0, 0, 0, 0, 0):
            check = _folded(check, value)
        check ^= np.where(v == 0, _BECH32, _BECH32M)
        full = np.concatenate([data, (check[:, None] >> (5 * np.arange(5, -1, -1))) & 31], axis=1)
        codes = np.frombuffer(ALPHABET_32, np.uint8)[full]
        out[here] = ["bc1" + r.tobytes().decode("ascii") for r in codes]
    return pd.Series(out)


# ------------------------------------------------------------------ validity
def checksum_state(value: Column) -> Column:
    """NULL: not a hex address.  not_encoded: one case, so no checksum.  valid / invalid: EIP-55."""
    body = F.substring(value, 3, 40)
    syntax = value.rlike(EVM_ADDRESS)
    one_case = (body == F.lower(body)) | (body == F.upper(body))
    return (F.when(~F.coalesce(syntax, F.lit(False)), F.lit(None).cast("string"))
            .when(one_case, "not_encoded")
            .when(mixed_case_checksum(F.when(syntax & ~one_case, body)), "valid").otherwise("invalid"))


def bitcoin_valid(value: Column) -> Column:
    """Checksum and version of a Bitcoin address; ``value`` is a trimmed cell."""
    v = F.coalesce(value, F.lit(""))
    legacy, witness = F.substring(v, 1, 1).isin("1", "3"), F.lower(F.substring(v, 1, 3)) == "bc1"
    raw = base58_payload(F.when(legacy, v))
    head = F.substring(raw, 1, 21)
    twice = F.sha2(F.unhex(F.sha2(head, 256)), 256)
    base58 = (F.substring(twice, 1, 8) == F.lower(F.hex(F.substring(raw, 22, 4)))) & \
        F.hex(F.substring(raw, 1, 1)).isin("00", "05")
    same_case = (v == F.lower(v)) | (v == F.upper(v))
    segwit = segwit_checksum(F.when(witness & same_case, F.lower(v)))
    return F.when(legacy, F.coalesce(base58, F.lit(False))).when(witness, F.coalesce(segwit, F.lit(False))).otherwise(False)


#: The families that are always there; a registry may hold more (``Registry.with_family``).
FAMILIES = {"evm": Family(lambda v: checksum_state(v) != "invalid", lambda v: v.rlike(EVM_HASH), F.lower),
            "bitcoin": Family(bitcoin_valid, lambda v: strip(v).rlike(BTC_HASH))}


def families(reg: Registry) -> dict[str, Family]:
    return {**FAMILIES, **reg.families}


def chains_of(reg: Registry, family: str) -> list[str]:
    return [c for c, s in reg.chains.items() if s["family"] == family]


def address_valid(reg: Registry, chain: Column, value: Column, without: tuple[str, ...] = ()) -> Column:
    """Validity on a chain given per row; FALSE when the chain has no check.  ``value`` is a trimmed cell."""
    out = F.when(F.lit(False), F.lit(False))
    for name, family in families(reg).items():
        if name not in without and chains_of(reg, name):
            here = chain.isin(chains_of(reg, name))
            out = out.when(here, F.coalesce(family.address(F.when(here, value)), F.lit(False)))
    return out.otherwise(False)


def transaction_valid(reg: Registry, chain: str, value: Column) -> Column:
    return F.coalesce(families(reg)[reg.chains[chain]["family"]].transaction(value), F.lit(False))
