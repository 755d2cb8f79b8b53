"""cohortshare: governed preparation and sharing of clinical tables on Apache Spark.

Every job is a DataFrame plan: generalisation and k-anonymity, Laplace noise,
chained-regression imputation, BIO tagging and entity scoring, terminology
mapping, and an access-grant ledger (batch and streaming).
"""

__version__ = "0.1.0"
