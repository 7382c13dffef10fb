from tideline.streaming.drain import LateRows, deliver, drain, drain_batches, drain_lines
from tideline.streaming.live import (stream_dedupe, stream_enrich, stream_error_rate,
                                     stream_incidents, stream_period_state)
from tideline.streaming.ordered import stream_error_recovery, stream_replay_state

__all__ = ["LateRows", "deliver", "drain", "drain_batches", "drain_lines", "stream_dedupe",
           "stream_enrich", "stream_error_rate", "stream_error_recovery", "stream_incidents",
           "stream_period_state", "stream_replay_state"]
