from .tables import (append_log, audit_rows, last_updates, upsert, write_json, write_profiles, write_report, write_version)
from .versions import (compact_table, create_table, delete_rows, latest_version, manifest, read_table, restore_version, upsert_table)

__all__ = ["append_log", "audit_rows", "compact_table", "create_table", "delete_rows", "last_updates", "latest_version", "manifest", "read_table",
           "restore_version", "upsert", "upsert_table", "write_json", "write_profiles", "write_report", "write_version"]
