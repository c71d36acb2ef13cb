"""Part of the core library; nothing here imports the llm subpackage."""
