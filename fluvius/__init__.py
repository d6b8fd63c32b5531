"""fluvius: river-network and document analytics expressed as Spark plans."""
