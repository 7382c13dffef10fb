from tideline.sources.faults import observed_log, with_arrival
from tideline.sources.logs import (parse_lines, parse_quarantine, read_events, read_events_stream,
                                   read_lines, read_table)
from tideline.sources.versions import clean, publish, published, read_published, withdraw
from tideline.sources.quarantine import (admitted, quarantined, readmit, store_lines)
from tideline.sources.sinks import (idempotent_sink, read_batches, read_dated, write_dated,
                                    write_timeline)

__all__ = ["admitted", "clean", "idempotent_sink", "observed_log", "parse_lines", "parse_quarantine",
           "publish", "published", "quarantined", "read_batches", "read_dated", "read_events",
           "read_events_stream", "read_lines", "read_published", "read_table", "readmit",
           "store_lines", "with_arrival", "withdraw", "write_dated", "write_timeline"]
