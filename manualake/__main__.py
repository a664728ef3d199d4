"""python -m manualake PATH meta | machines [BRAND] | documents PRODUCT | fault NUMBER | faults | menu [NUMBER] | maintenance | part NUMBER | parts PRODUCT | drawings PRODUCT | search TEXT"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.knowledge_base import KnowledgeBase

COMMANDS = ("meta", "machines", "documents", "fault", "faults", "menu", "maintenance", "part", "parts", "drawings", "search")


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in COMMANDS:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("manualake").getOrCreate()
    given = [" ".join(args[2:])] if args[2:] else []
    getattr(KnowledgeBase(spark, args[0]), {"fault": "faults"}.get(args[1], args[1]))(*given).show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
