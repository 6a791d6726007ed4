"""Readers and writers."""

from tabwright.sources.files import labelled_files
from tabwright.sources.models import load_model, save_model
from tabwright.sources.tables import (clear_checkpoint, load_checkpoint, load_table, read_csv, save_checkpoint,
                                      write_csv, write_missing_report)

__all__ = ["labelled_files", "load_model", "save_model", "clear_checkpoint", "load_checkpoint", "load_table",
           "read_csv", "save_checkpoint", "write_csv", "write_missing_report"]
