from .cells import (address_kind, cell_text, clean_record_id, contains_text, cost_usd, csv_cell_type,
                    float_text, full_match, mask_prefix, parse_time, pattern_key, record_key_json,
                    search, to_number)

__all__ = ["address_kind", "cell_text", "clean_record_id", "contains_text", "cost_usd", "csv_cell_type",
           "float_text", "full_match", "mask_prefix", "parse_time", "pattern_key", "record_key_json",
           "search", "to_number"]
