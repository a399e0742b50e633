"""Names followed to their declarations, and what public declarations reach.

Both are frontier loops: each round joins only what the last round found, and is written to the
checkpoint folder, so neither plan nor state grows with the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def resolve_names(exports: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """Where each exported name is declared: (file, name, declared_file, declared_name) and whether
    all chains ended within `rounds`.

    exports: file, name, from_file, from_name; from_file null is a declaration, name '*' passes on
    every name of from_file."""
    done = checkpointed(exports.where("from_file is null and name <> '*'").selectExpr("file", "name", "file as declared_file", "name as declared_name").distinct())
    front = done
    renames = exports.where("from_file is not null and name <> '*'").selectExpr("file as to_file", "name as to_name", "from_file as file", "from_name as name")
    stars = exports.where("from_file is not null and name = '*'").selectExpr("file as to_file", "from_file as file")
    for _ in range(rounds):
        step = front.join(renames, ["file", "name"]).selectExpr("to_file as file", "to_name as name", "declared_file", "declared_name")
        passed = front.where("name <> 'default'").join(stars, "file").selectExpr("to_file as file", "name", "declared_file", "declared_name")
        front = checkpointed(step.unionByName(passed).distinct().join(done, ["file", "name", "declared_file", "declared_name"], "left_anti"))
        if not front.limit(1).count():
            return done, True
        done = checkpointed(done.unionByName(front))
    return done, False


def reachable(roots: DataFrame, refs: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, hops): everything that `roots` (node) reach over `refs` (src, dst), within `depth` hops
    if given, with the fewest hops."""
    done = checkpointed(roots.select("node").distinct().withColumn("hops", F.lit(0)))
    front, n = done, 0
    while depth is None or n < depth:
        n += 1
        found = front.join(refs, front.node == refs.src).select(F.col("dst").alias("node")).distinct()
        front = checkpointed(found.join(done, "node", "left_anti").withColumn("hops", F.lit(n)))
        if not front.limit(1).count():
            break
        done = checkpointed(done.unionByName(front))
    return done
