"""Session settings that fit the amount of data to be shuffled."""

import math

MIB = 1 << 20


def session_settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a session whose largest shuffle moves ``shuffle_bytes``.

    Spark's fixed 200 shuffle partitions would be 150 GB each for 30 TB. Partitions
    of 128 MiB, which a task can sort in memory, are right up to 64 GiB and never
    fewer than the cores. At 100 TB they would be 745,000, and with as many map tasks
    the shuffle some 5e11 blocks of 180 bytes. So above 64 GiB partitions grow with
    the square root of the volume, to 5 GiB at 100 TB (a sort that spills is cheaper
    than that many blocks), and scan tasks with its fourth root, to 0.8 GiB.

    Adaptive execution merges what turns out small and splits partitions that a hot
    key makes large. Files are taken to be four times their compressed size, so that
    a table is not broadcast because it compresses well.
    """
    if shuffle_bytes < 0 or cores < 1:
        raise ValueError("shuffle_bytes must not be negative, cores at least 1")
    growth = max(1.0, shuffle_bytes / (64 * 1024 * MIB))
    partitions = max(cores, math.ceil(shuffle_bytes / (128 * MIB * growth**0.5)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(int(128 * MIB * growth**0.25)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MIB),
        "spark.sql.sources.fileCompressionFactor": "4",
        "spark.sql.session.timeZone": "UTC",
    }
