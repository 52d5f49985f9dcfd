"""Register frames of the gas module: checksum, validation and decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamwatch import constants as K
from seamwatch.functions.core import compute_once, let
from seamwatch.functions.text import lookup


def _crc_table() -> list[int]:
    """The 256 byte steps of CRC-16 with the reflected polynomial 0xA001."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ 0xA001 if value & 1 else value >> 1
        table.append(value)
    return table


CRC_STEPS = _crc_table()
_UNPACKED = T.StructType([
    T.StructField("bytes", T.ArrayType(T.IntegerType())), T.StructField("crc", T.IntegerType()),
])


def frame_bytes(frame: Column) -> Column:
    """Binary value -> array of unsigned byte values."""
    digits = "0123456789ABCDEF"

    def unpack(text: Column) -> Column:
        def nibble(at: Column) -> Column:
            return F.position(F.substr(text, at, F.lit(1)), F.lit(digits)) - 1
        return F.transform(
            F.sequence(F.lit(1), F.length(text), F.lit(2)), lambda i: nibble(i) * 16 + nibble(i + 1)
        )

    size = F.octet_length(frame)
    return F.when(size > 0, let(F.hex(frame), unpack)).otherwise(F.array().cast("array<int>"))


def crc16(values: Column) -> Column:
    """CRC-16 of an array of byte values, start value 0xFFFF."""
    steps = F.array(*[F.lit(step) for step in CRC_STEPS])
    return F.aggregate(
        values,
        F.lit(0xFFFF),
        lambda crc, byte: F.shiftright(crc, 8).bitwiseXOR(
            F.get(steps, crc.bitwiseXOR(byte).bitwiseAND(F.lit(255)))
        ),
    )


@F.pandas_udf(_UNPACKED)
def unpack_frames(frames: pd.Series) -> pd.DataFrame:
    """Byte values of every frame and the checksum of all but its last two bytes.

    The checksum runs over a whole Arrow batch, one byte position at a time.
    """
    raw = [frame or b"" for frame in frames]
    sizes = np.array([len(frame) for frame in raw])
    table = np.zeros((len(raw), max(1, sizes.max())), np.int64)
    table[np.arange(table.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    steps, crc = np.array(CRC_STEPS), np.full(len(raw), 0xFFFF)
    for place in range(table.shape[1] - 2):
        moved = (crc >> 8) ^ steps[(crc ^ table[:, place]) & 255]
        crc = np.where(place < sizes - 2, moved, crc)
    values = [row[:size] for row, size in zip(table.astype(np.int32), sizes)]
    return pd.DataFrame({"bytes": values, "crc": crc.astype(np.int32)})


def frame_error(values: Column, crc: Column, slave_id: Column, registers: int = 6) -> Column:
    """First rule a response frame breaks, or null for a valid one."""
    size = F.size(values)
    want = 5 + 2 * registers
    tail = F.get(values, size - 2) + F.shiftleft(F.get(values, size - 1), 8)
    slave, function, count = (F.get(values, F.lit(i)) for i in range(3))
    return (
        F.when(size < 5, F.concat(F.lit("响应长度过短："), size))
        .when(tail != crc, "CRC 校验失败")
        .when(slave != slave_id, F.format_string("从机地址不匹配：期望 %d，收到 %d", slave_id, slave))
        .when(function.bitwiseAND(F.lit(128)) != 0, F.concat(F.lit("Modbus 异常响应，异常码 "), count))
        .when(size != want, F.format_string(f"响应长度不匹配：期望 {want}，收到 %d", size))
        .when(function != 3, F.format_string("功能码不匹配：收到 0x%02X", function))
        .when(count != 2 * registers, F.format_string(f"数据字节数不匹配：期望 {2 * registers}，收到 %d", count))
    )


def frame_registers(values: Column, registers: int = 6) -> Column:
    """Big-endian 16-bit registers of a valid frame."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(registers - 1)),
        lambda i: F.get(values, 3 + 2 * i) * 256 + F.get(values, 4 + 2 * i),
    )


def decode_registers(rows: DataFrame, registers: str) -> DataFrame:
    """Adds value, decimals, value_text, unit, status and error from a register array.

    Register 0 carries unit, decimal places and the two top value bits,
    register 1 the low 16 value bits, the low byte of register 5 the status.
    ``value_text`` keeps the declared number of decimal places.  The codes are
    cut out first and the texts built in a second step: one big expression
    would exceed what the JVM compiles to machine code.
    """
    head, low, tail = (F.get(F.col(registers), F.lit(i)) for i in (0, 1, 5))

    def bits(value: Column, shift: int, mask: int) -> Column:
        return F.shiftright(value, shift).bitwiseAND(F.lit(mask))

    coded = compute_once(
        rows, _decimal_code=bits(head, 8, 15), _unit=bits(head, 12, 15), _status=bits(tail, 0, 255),
        _raw=F.shiftleft(bits(head, 6, 3), 16).bitwiseOR(low), _size=F.size(registers),
    )
    scaled = compute_once(
        coded,
        decimals=F.when(F.col("_size") >= 6, lookup(K.DECIMAL_CODES, F.col("_decimal_code"))),
        _digits=F.col("_raw").cast("string"),
    )
    places, digits = F.col("decimals"), F.col("_digits")
    padded = compute_once(scaled, _padded=F.lpad(digits, F.greatest(places + 1, F.length(digits)), F.lit("0")))
    ok, text = places.isNotNull(), F.col("_padded")
    point = F.length(text) - places
    valued = compute_once(
        padded,
        value=(F.col("_raw").cast("decimal(9,0)") / lookup({0: 1, 1: 10, 2: 100, 3: 1000}, places)).cast("decimal(18,3)"),
        value_text=F.when(places == 0, text).otherwise(
            F.concat(F.substr(text, F.lit(1), point), F.lit("."), F.substr(text, point + 1, places))),
    )
    unit = F.coalesce(lookup(K.UNIT_CODES, F.col("_unit")), F.format_string("unknown(0x%X)", F.col("_unit")))
    status = F.coalesce(lookup(K.STATUS_CODES, F.col("_status")), F.format_string("unknown(0x%02X)", F.col("_status")))
    error = F.when(F.col("_size") < 6, F.lit("解析气体数据至少需要6个寄存器")).when(
        ~ok, F.format_string("未知的小数位编码：0x%X", F.col("_decimal_code")))
    return valued.select(
        *rows.columns, "value", "decimals", "value_text",
        F.when(ok, unit).alias("unit"), F.when(ok, status).alias("status"), error.alias("error"),
    )
