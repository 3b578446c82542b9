"""Lodestrand: retrieval and retrieval evaluation over document collections as Spark plans."""
