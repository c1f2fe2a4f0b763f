"""The built-in sample: four regions of five rows, so that regions may be shown under the usual group size and people may not."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from gatedframe.model import Dataset
from gatedframe.sources.delimited import build_dataset

SAMPLE_NAME = "sample_sales.csv"

#: The rows of the sample, which golden results refer to.
SAMPLE = """region,rep,deal_size,closed_on,segment,status
North,Ada Lovelace,12500,2026-01-05,Enterprise,won
North,Ada Lovelace,8200,2026-01-19,Mid-market,won
North,Bob Chen,3100,2026-01-20,SMB,lost
South,Cleo Marsh,41000,2026-02-02,Enterprise,won
South,Cleo Marsh,5400,2026-02-15,SMB,won
South,Bob Chen,7300,2026-02-18,Mid-market,lost
East,Dev Rao,96000,2026-01-30,Enterprise,won
East,Dev Rao,2200,2026-03-04,SMB,won
East,Eve Nakamura,15800,2026-03-11,Mid-market,won
West,Eve Nakamura,,2026-03-20,Mid-market,open
West,Priya Shah,22400,2026-03-22,Enterprise,won
West,Priya Shah,1900,2026-04-02,SMB,lost
North,Ada Lovelace,33000,2026-04-14,Enterprise,won
South,Cleo Marsh,4700,2026-04-19,SMB,open
East,Dev Rao,58000,2026-05-03,Enterprise,won
West,Priya Shah,9100,2026-05-12,Mid-market,won
North,Bob Chen,6400,2026-05-21,SMB,won
South,Cleo Marsh,275000,2026-06-01,Enterprise,won
East,Eve Nakamura,3300,2026-06-09,SMB,lost
West,Priya Shah,11200,2026-06-18,Mid-market,won"""


def sample_dataset(spark: SparkSession, taken: Iterable[str] = ()) -> Dataset:
    return build_dataset(spark, SAMPLE_NAME, SAMPLE.encode(), taken)
