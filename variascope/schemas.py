"""Schemas of the domain inputs."""

from __future__ import annotations

SAMPLES = "Path string, Sample string, ReferenceGenome string, ProviderName string, Subject string, Outgroup int"
SAMPLES_CASE = "Path string, Sample string, ReferenceGenome string, Outgroup int"
PILEUP = "chrom string, pos long, ref string, depth int, bases string, bq string, mq string, tails string"
FAI = "contig string, len long, offset long, bases int, width int"
