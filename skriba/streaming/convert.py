"""Streams: conversion is per row, so it works on them unchanged; first-wins keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriba.functions.orthography import convert_text


def convert_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return stream.withColumn("latin", convert_text(F.col(text)))


def first_stems(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark passes them."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
