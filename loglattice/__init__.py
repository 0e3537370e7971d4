"""Spark-native collection, parsing and cleaning of line-oriented logs."""

__version__ = "0.1.0"

#: The public names, by the module that has each; modules are loaded when a name is first used.
_NAMES = {
    "Collector": "streaming.collector", "Metrics": "streaming.metrics", "serve_metrics": "streaming.metrics:serve", "Options": "options", "CollectorOptions": "options", "MultilineOptions": "options",
    "ParserOptions": "options", "SinkOptions": "options", "OptionError": "options", "load_options": "options:load", "FileTracker": "sources.discovery", "TrackedFile": "sources.discovery",
    "file_identity": "sources.discovery:identity", "inode_of": "sources.discovery", "FileSizeTooSmall": "sources.discovery", "NotEnoughSeparators": "sources.discovery", "FingerprintMismatch": "sources.discovery",
    "OffsetStore": "sources.offsets", "register_logtail": "sources.logtail:register", "build_sink": "sinks.writers:build",
}
__all__ = [*_NAMES, "__version__"]


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(name)
    from importlib import import_module

    module, _, inner = _NAMES[name].partition(":")
    return getattr(import_module(f"loglattice.{module}"), inner or name)
