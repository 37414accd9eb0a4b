"""Equipment messages: item codec, messages, framing and state machines, free of Spark and of I/O."""
