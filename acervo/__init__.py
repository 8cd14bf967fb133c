"""acervo: retrieval and analysis of long-form documents as Spark plans."""
