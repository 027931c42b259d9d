from .validate import each_batch, stream_suspects, stream_suspects_and_late, stream_suspects_once, write_stream

__all__ = ["each_batch", "stream_suspects", "stream_suspects_and_late", "stream_suspects_once", "write_stream"]
