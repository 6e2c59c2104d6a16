"""Fixed values of the catalogue search: targets with their organisms, and runs that are always kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Label, organisms.
TARGETS = [
    ("panax", ["Panax ginseng", "Panax quinquefolius", "Panax notoginseng"]),
    ("platycodon", ["Platycodon grandiflorus"]),
    ("scutellaria", ["Scutellaria baicalensis"]),
    ("glycyrrhiza", ["Glycyrrhiza uralensis", "Glycyrrhiza glabra"]),
    ("rehmannia", ["Rehmannia glutinosa"]),
    ("schisandra", ["Schisandra chinensis"]),
    ("astragalus", ["Astragalus mongholicus", "Astragalus membranaceus"]),
    ("angelica", ["Angelica gigas", "Angelica sinensis"]),
]

#: Label, accession, bioproject, organism, release_date, reason.
FALLBACK = [
    ("positive_control", "SRR9968562", "unknown", "Waxsystermes-associated sample", "legacy", "PalmID tutorial positive control"),
    ("panax_legacy", "SRR4835279", "unknown", "Panax ginseng", "2017", "legacy medicinal-plant probe"),
    ("panax_legacy", "SRR4835278", "unknown", "Panax ginseng", "2017", "legacy medicinal-plant replicate"),
]


def targets(spark: SparkSession) -> DataFrame:
    """(label, organism), one row for each; small by construction."""
    return spark.createDataFrame([(label, o) for label, organisms in TARGETS for o in organisms], "label string, organism string")


def fallback_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACK, "label string, accession string, bioproject string, organism string, release_date string, reason string")
