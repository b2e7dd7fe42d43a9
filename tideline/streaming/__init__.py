"""Running pipelines: control store, leadership, delivery, observability."""
