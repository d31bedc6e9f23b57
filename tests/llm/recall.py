"""Recall of the neighbour search against brute force, and how far vectors travel: ``python tests/llm/recall.py [folder] [block rows ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tests.llm.test_neighbours import brute  # noqa: E402
from tidelog.llm import neighbours as N  # noqa: E402
from tidelog.session import local_session, table  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    nodes = table(spark, folder, "hnsw_nodes")
    top = brute(nodes, 10)
    for block_rows in [int(b) for b in sys.argv[2:]] or [N.BLOCK_ROWS, 512]:
        began = time.perf_counter()
        got = N.most_similar(nodes, 10, block_rows=block_rows).select("vector_id", "neighbour", "similarity").collect()
        took = time.perf_counter() - began
        least = {i: near[-1][1] for i, near in top.items() if near}  # of equally similar ones any is right
        hits = sum(r["similarity"] >= least[r["vector_id"]] - 1e-6 for r in got)
        print(f"blocks of {block_rows}: recall {hits / sum(map(len, top.values())):.5f}, {took:.1f} s")
        for least_similarity in (None, 0.9):
            for r in N.fan_out(nodes, 10, least_similarity, block_rows).where("blocks > 1").orderBy("ns", "dims").collect():
                print(f"  {r['ns']} {r['dims']}, least {least_similarity}: {r['vectors']} vectors, {r['blocks']} blocks, each sent to {r['sent'] / r['vectors']:.2f} pairs of blocks")
    spark.stop()


if __name__ == "__main__":
    main()
