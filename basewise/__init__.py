"""basewise: k-mer analytics over sequencing reads, expressed as Spark plans."""

__version__ = "0.1.0"
