from .arrays import json_elements, read_json_array
from .feed import bad_envelopes, changed_rows, envelope_schema, read_feed, read_feed_after, read_kafka_feed, sequence_order
from .files import (coerce_csv, csv_types, read_csv_text, read_json_documents, read_json_lines, read_typed_json,
                    typed_json_schema)
from .shards import ShardFeed, read_shards, shard_changes, shard_rejects, stream_shards
from .tables import (changed_between, display_order, filtered_scan, head_sample, latest_state, project)

__all__ = ["bad_envelopes", "sequence_order", "changed_rows", "envelope_schema", "read_feed", "read_feed_after", "read_kafka_feed", "coerce_csv",
           "csv_types", "read_csv_text", "read_json_documents", "read_json_lines", "read_typed_json",
           "typed_json_schema", "changed_between", "display_order", "filtered_scan", "head_sample", "latest_state",
           "project", "ShardFeed", "read_shards", "shard_changes", "shard_rejects", "stream_shards", "json_elements", "read_json_array"]
