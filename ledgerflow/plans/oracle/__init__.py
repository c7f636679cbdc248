"""The registered queries again, as SQL for a second engine."""
