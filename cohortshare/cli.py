"""Command line: ``python -m cohortshare.cli <job> ...``.

Jobs mirror the reference's scripts, as Spark jobs over whole tables:

  impute       --input records.csv --output out [--estimator bayes_ridge|ols]
  convert      --input examples.json --output bio_dir [--short-types]
  map-terms    --input records.csv --output out [--column disease_name_raw] [--vocab vocab.csv] [--min-score 0.5]
               or --term TEXT to map one term
  deidentify   --input records.csv --output out [--key patient_id --salt S]
  train-tagger --train bio_path --output model_dir [--max-iter 20]
  tag          --model model_dir --input records.csv --output entities [--column clinical_note]
  ledger       --input requests.parquet --output out
  mlm          --corpus corpus.txt --output out [--salt S] [--max-len 512] [--dense]

Inside a cluster job the existing session is used (its ``spark.checkpoint.dir``
is read, not replaced); run locally, a ``local[*]`` session is created.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def _spark() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from .session import local_session
    return local_session("*")


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="cohortshare")
    sub = ap.add_subparsers(dest="job", required=True)
    p = sub.add_parser("impute")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--estimator", default="bayes_ridge", choices=["bayes_ridge", "ols"])
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p = sub.add_parser("convert")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--short-types", action="store_true")
    p.add_argument("--json-lines", action="store_true")
    p = sub.add_parser("map-terms")
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--term")
    p.add_argument("--column", default="disease_name_raw")
    p.add_argument("--vocab")
    p.add_argument("--min-score", type=float)
    p = sub.add_parser("deidentify")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--key")
    p.add_argument("--salt", default="")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p = sub.add_parser("train-tagger")
    p.add_argument("--train", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--max-iter", type=int, default=20)
    p = sub.add_parser("tag")
    p.add_argument("--model", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--column", default="clinical_note")
    p.add_argument("--key", default="patient_id")
    p = sub.add_parser("ledger")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p = sub.add_parser("mlm")
    p.add_argument("--corpus", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--salt", default="")
    p.add_argument("--max-len", type=int, default=512)
    p.add_argument("--probability", type=float, default=0.15)
    p.add_argument("--dense", action="store_true")
    a = ap.parse_args(argv)

    spark = _spark()
    from .plans import jobs
    if a.job == "impute":
        n = jobs.impute_job(spark, a.input, a.output, fmt=a.format, estimator=a.estimator)
        print(f"{n} missing cells filled, written to {a.output}")
    elif a.job == "convert":
        from .functions.tags import SHORT_TYPE_MAP
        n = jobs.convert_job(spark, a.input, a.output, type_map=SHORT_TYPE_MAP if a.short_types else None,
                             multiline=not a.json_lines)
        print(f"{n} annotated examples written as BIO text to {a.output}")
    elif a.job == "map-terms":
        from .sources.vocab import default_vocab, read_vocab
        vocab = read_vocab(spark, a.vocab) if a.vocab else default_vocab(spark)
        kw = {"min_score": a.min_score} if a.min_score is not None else {}
        if a.term is not None:
            df = spark.createDataFrame([(a.term,)], "term string")
            r = jobs.map_terms_job(spark, df, "term", vocab, **kw).first()
            print(f"{a.term}: code {r.code}, score {r.score}, {r.status}")
        else:
            from .sources import records
            out = jobs.map_terms_job(spark, records.read_records(spark, a.input), a.column, vocab, **kw)
            records.write_records(out, a.output)
    elif a.job == "deidentify":
        rep = jobs.deidentify_job(spark, a.input, a.output, fmt=a.format, key=a.key, salt=a.salt)
        print(f"kept {rep['records_out']} of {rep['records_in']} records; information loss {rep['information_loss']} %, "
              f"risk {rep['reid_risk']} %")
    elif a.job == "train-tagger":
        from .operators.tagger import train_tagger
        from .sources.bio_io import read_bio
        model = train_tagger(read_bio(spark, a.train), max_iter=a.max_iter)
        model.save(spark, a.output)
        print(f"tagger written to {a.output}")
    elif a.job == "tag":
        from .operators.tagger import LinearTagger, tag_notes
        from .sources import records
        ents = tag_notes(LinearTagger.load(spark, a.model), records.read_records(spark, a.input), a.key, a.column)
        ents.write.mode("overwrite").parquet(a.output)
    elif a.job == "ledger":
        from .operators.ledger import apply_requests
        from .sources.requests import read_requests
        res = apply_requests(read_requests(spark, a.input))
        res.results.write.mode("overwrite").parquet(f"{a.output}/results")
        res.assets.write.mode("overwrite").parquet(f"{a.output}/assets")
        res.release()
        print(json.dumps({"results": f"{a.output}/results", "assets": f"{a.output}/assets"}))
    elif a.job == "mlm":
        from pyspark.sql import functions as F
        from .operators import mlm
        from .sources.bio_io import read_corpus
        corpus = read_corpus(spark, a.corpus).withColumn("doc_id", F.monotonically_increasing_id())
        fn = mlm.mlm_blocks if a.dense else mlm.mlm_examples
        fn(corpus, "doc_id", "text", salt=a.salt, max_len=a.max_len, probability=a.probability) \
            .write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
