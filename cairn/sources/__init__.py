"""Sources: file trees and archives."""
