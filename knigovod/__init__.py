"""knigovod: invoice documents to verified, balanced ledger rows, as Spark jobs."""
