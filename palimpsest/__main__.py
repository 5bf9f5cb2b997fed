"""``python -m palimpsest --folder F``: a short tour; with ``--serve`` the HTTP face."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from palimpsest import Store, StoreConfig


def tour(store: Store) -> None:
    with store.begin() as txn:
        txn.set(b"hello", b"world")
        txn.set(b"bye", b"world")
    with store.begin() as txn:
        txn.delete(b"bye")
    print("hello:", store.get(b"hello"), "bye:", store.get(b"bye"))
    store.history().show()
    print(store.metrics())


def main() -> None:
    parser = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    parser.add_argument("--folder", required=True, help="folder of the store, a path or URI")
    parser.add_argument("--serve", action="store_true", help="serve HTTP until interrupted")
    parser.add_argument("--port", type=int, default=8080)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, StoreConfig(args.folder))
    if not args.serve:
        return tour(store)
    from palimpsest.service import serve

    server = serve(store, port=args.port)
    print(f"serving on {server.server_address}")
    try:
        server.serve_forever()
    finally:
        store.close()


if __name__ == "__main__":
    main()
