"""Sources and sinks: file readers (A1-A6) and adapters from the driver tables."""

from voxlex.sources.files import (
    read_transcript, read_tsv, read_responses, read_mask, save_stage, load_stage,
)
from voxlex.sources import fixtures

__all__ = ["read_transcript", "read_tsv", "read_responses", "read_mask",
           "save_stage", "load_stage", "fixtures"]
